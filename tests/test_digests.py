"""Uploads compared with digests of the active sales, and the log behind their generations and the active version."""

import random

import pytest
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import audit
from shelfcast.operators.digests import SalesDigests
from shelfcast.sources import artifacts, files


@pytest.fixture
def tables(make_sales):
    """Active sales and an upload that overlap, with nulls, negative zeros, repeated rows and unreadable dates."""
    rng = random.Random(6)

    def rows(n, months):
        when = lambda: rng.choice((None, *[f"2023-{m:02d}-{rng.randint(1, 28):02d} 0{rng.randint(0, 9)}:30" for m in months]))
        one = lambda: rng.choice(("a", "b", None, "a:1"))
        return [(one(), one(), "p", when(), rng.choice((0.0, -0.0, 1.5, None)), rng.choice((1.0, None)), rng.choice((0.0, -0.0))) for _ in range(n)]

    old = rows(600, (1, 2, 3, 4))
    new = rng.sample(old, 200) + rows(300, (4, 5)) + [("a", "b", "p", "2023-04-01", 7.0)] * 150
    return make_sales(old), make_sales(new), (lambda r: make_sales(r)), old


def kept(spark, tmp_path, parts):
    digests = SalesDigests(spark, str(tmp_path / "digests"))
    for part in parts:
        digests.append(part)
    return digests


def test_same_as_reading_the_sales(spark, tables, tmp_path):
    active, upload, _, old = tables
    third = F.pmod(F.xxhash64(s.BILL_DATE, s.QUANTITY), F.lit(3))
    digests = kept(spark, tmp_path, [active.where(third == k) for k in range(3)])
    assert digests.generations() == 3

    def plain(rows):
        return sorted((tuple(v + 0.0 if isinstance(v, float) else v for v in r) for r in rows.collect()), key=repr)

    assert plain(digests.new_rows(upload)) == plain(audit.new_rows(upload, active)) != []
    assert audit.upload_summary(upload, digests=digests).first() == audit.upload_summary(upload, active).first()
    assert digests.new_rows(active).count() == 0


def test_only_the_months_of_the_upload_are_read(spark, tables, tmp_path):
    active, _, make, old = tables
    digests = kept(spark, tmp_path, [active])
    may = make([("a", "b", "p", "2023-05-02", 1.0)])
    plan = digests.mark(may.select(*s.REQUIRED), "known")._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:] if "month#" in part.split("]")[0]]
    assert len(filters) >= 2 and all("202305" in f for f in filters)  # those of the words and of the digests
    wider = make([r for r in old if r[3] and r[3] > "2023-03"])
    assert digests.new_rows(wider).count() == 0


def test_filter_rules_out_most_rows_and_none_that_are_there(spark, tmp_path):
    base = spark.range(20_000).select(
        F.lit("r").alias(s.REGION), F.lit("s").alias(s.STORE), F.col("id").cast("string").alias(s.PRODUCT), F.lit("2023-01-05").alias(s.BILL_DATE),
        F.lit(1.0).alias(s.QUANTITY), F.lit(1.0).alias(s.MRP), F.lit(0.0).alias(s.DISCOUNT_AMOUNT),
    )
    even = F.col(s.PRODUCT).cast("long") % 2 == 0
    digests = kept(spark, tmp_path, [base.where(even)])
    from shelfcast.operators.digests import keyed

    probe = keyed(base, s.REQUIRED).select("month", "digest", even.alias("even"))
    passed = digests.suspects(probe.select("month", "digest"), ["202301"], [1]).join(probe, ["month", "digest"])
    counts = {r["even"]: r["count"] for r in passed.groupBy("even").count().collect()}
    assert counts[True] == 10_000 and counts.get(False, 0) < 800


def test_no_active_sales_and_no_upload(spark, tables, tmp_path):
    active, upload, make, _ = tables
    nothing = SalesDigests(spark, str(tmp_path / "none"))
    assert nothing.generations() == 0
    assert nothing.new_rows(upload).count() == audit.new_rows(upload, None).count()
    assert kept(spark, tmp_path, [active.limit(0), active]).new_rows(upload.limit(0)).count() == 0


def test_a_log_takes_one_of_two_writers(spark, tmp_path):
    log = str(tmp_path / "log")
    assert files.last_entry(spark, log) == (0, None)
    assert files.append_entry(spark, log, 1, "first") and not files.append_entry(spark, log, 1, "late")
    assert files.last_entry(spark, log) == (1, "first")
    assert files.append_entry(spark, log, 2, "second") and files.last_entry(spark, log) == (2, "second")
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith(".")) == ["000000001", "000000002"]


def test_an_unfinished_generation_does_not_count(spark, tables, tmp_path, monkeypatch):
    """A failure after any of the writes leaves the sales as they were; the next attempt takes the same number."""
    active, upload, _, _ = tables
    digests = kept(spark, tmp_path, [active.limit(100)])
    before = digests.new_rows(upload).count()
    monkeypatch.setattr("shelfcast.operators.digests.append_entry", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        digests.append(active)
    assert digests.generations() == 1 and digests.new_rows(upload).count() == before
    monkeypatch.undo()
    assert digests.append(active) == 2 and digests.new_rows(upload).count() == audit.new_rows(upload, active).count()
    monkeypatch.setattr(digests, "generations", lambda: 1)  # as a writer sees it who read before the other had ended
    with pytest.raises(RuntimeError, match="another writer"):
        digests.append(active)


class Anything:
    """A model that only writes a file where a pipeline's metadata are."""

    def __init__(self, spark):
        self.spark = spark

    def write(self):
        return self

    overwrite = write

    def save(self, path):
        self.spark.range(1).write.mode("overwrite").parquet(f"{path}/metadata")


class Codes:
    def __init__(self, tables):
        self._tables = tables

    def tables(self):
        return self._tables


def staged(spark, root, version, leave_out=()):
    one = spark.range(1)
    names = [n for n in ("region", "store", "product", "product_store", "month_product") if n not in leave_out]
    artifacts.stage(root, version, Anything(spark), Codes({n: one for n in names}), one)


def test_promotion_between_two_writers_and_failures(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "models")
    for version in ("one", "two", "three"):
        staged(spark, root, version)
    artifacts.promote(spark, root, "one")
    with pytest.raises(artifacts.Conflict, match="one is active"):
        artifacts.promote(spark, root, "two", instead_of="zero")
    artifacts.promote(spark, root, "two", instead_of="one")
    # A writer that read the log before "two" was added comes too late.
    monkeypatch.setattr(artifacts, "last_entry", lambda spark, log: (1, "one"))
    with pytest.raises(artifacts.Conflict):
        artifacts.promote(spark, root, "three")
    monkeypatch.undo()
    assert artifacts.active_version(spark, root) == "two"
    for part in ("region", "month_product"):  # a stage that broke off before this part
        staged(spark, root, f"without-{part}", leave_out=(part,))
        with pytest.raises(RuntimeError, match=part):
            artifacts.promote(spark, root, f"without-{part}")
        assert artifacts.active_version(spark, root) == "two"
