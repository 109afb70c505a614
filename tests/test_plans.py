"""What the planner makes of the operators: shuffles, pushed filters, pruned columns, joins."""

import pytest
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import anchors, audit, cleaning, external, split
from shelfcast.operators.history import compact_history
from shelfcast.plans.features import feature_panel
from shelfcast.sources.sales import read_sales


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "sales")
    rows = spark.range(400).select(
        F.lit("R").alias(s.REGION),
        F.concat(F.lit("S"), F.col("id") % 7).alias(s.STORE),
        F.concat(F.lit("P"), F.col("id") % 11).alias(s.PRODUCT),
        F.expr("timestamp_ntz'2023-01-01' + make_interval(0, 0, 0, cast(id as int))").alias(s.BILL_DATE),
        F.col("id").cast("double").alias(s.QUANTITY),
        F.lit(10.0).alias(s.MRP),
        F.lit(1.0).alias(s.DISCOUNT_AMOUNT),
    )
    rows.write.parquet(path)
    return read_sales(spark, path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return plan_of(df).count("Exchange hashpartitioning")


def test_feature_panel_shuffles_twice(stored):
    panel = feature_panel(stored)
    assert shuffles(panel) == 2 and "Join" not in plan_of(panel)


def test_few_columns_reach_a_narrow_query(stored):
    daily = plan_of(audit.daily_totals(stored))
    assert "ReadSchema: struct<BillDate:timestamp_ntz,Quantity:double>" in daily
    assert shuffles(audit.daily_totals(stored)) == 1


def test_selections_reach_the_scan(stored):
    plan = plan_of(cleaning.up_to(cleaning.select_series(stored, store="S1", product="P2"), "2023-05-01"))
    for pushed in ("EqualTo(StoreName,S1)", "EqualTo(ProductName,P2)", "LessThanOrEqual(BillDate,2023-05-01T00:00)"):
        assert pushed in plan


def test_new_rows_need_no_join(stored):
    rows = audit.new_rows(stored, stored.where("Quantity < 5"))
    assert "Join" not in plan_of(rows) and "partial_min" in plan_of(rows) and shuffles(rows) == 1


def test_upload_summary_is_one_chain(stored):
    plan = plan_of(audit.upload_summary(stored, stored))
    assert "Join" not in plan and plan.count("FileScan") == 2


def test_split_compares_without_joining_the_panel(stored):
    panel = feature_panel(stored).select(*s.SERIES, s.WEEK_END)
    marked = plan_of(split.mark_train(panel))
    before_subquery = marked.split("Subquery")[0]
    assert "Join" not in before_subquery


def test_history_combines_before_the_shuffle(stored):
    plan = plan_of(compact_history(stored))
    assert "partial_sum" in plan and shuffles(compact_history(stored)) == 1


def test_no_join_compares_all_rows(spark, stored):
    panel = feature_panel(stored)
    for df in (
        anchors.daily_volatility(stored),
        anchors.last_known_metrics(stored),
        audit.missing_dates(stored),
        audit.sudden_changes(stored),
        cleaning.retraining_window(stored, strategy="rolling"),
        external.fill_mean(panel, [s.MRP]),
    ):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_shifted_features_do_not_see_their_week(make_sales):
    weeks = ["2024-01-03", "2024-01-10", "2024-01-17", "2024-01-24", "2024-02-07"]
    rows = [("R", "S", "P", day, 3.0 + i, 50.0, 10.0) for i, day in enumerate(weeks)]

    def features(sales):
        panel = feature_panel(make_sales(sales), shift=1, on_zero="zero")
        return {r[s.WEEK_END]: r for r in panel.drop("Quantity", "MRP").collect()}

    before, after = features(rows), features([*rows[:-1], ("R", "S", "P", weeks[-1], 90.0, 80.0, 5.0)])
    assert len(before) == 6 and before == after
    changed = features([*rows[:2], ("R", "S", "P", weeks[2], 90.0, 80.0, 5.0), *rows[3:]])
    assert [before[w] == changed[w] for w in sorted(before)][:4] == [True, True, True, False]
