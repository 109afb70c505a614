"""Upload checks (A, J, W, O, U, R)."""

import uuid

from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.functions.calendar import day
from shelfcast.operators import audit
from shelfcast.operators.cleaning import dedupe
from shelfcast.operators.digests import SalesDigests
from shelfcast.queries.oracle import COMPARED, rounded, sql
from shelfcast.queries.registry import query
from shelfcast.session import shared_dir
from shelfcast.sources.star_schema import active_sales, canonical_sales, uploaded_sales

DAILY = (s.STORE, s.BILL_DATE, s.QUANTITY)


@query("A4_daily_totals", sql("daily", "SELECT * FROM daily"))
def daily_totals(spark, sf):
    return audit.daily_totals(canonical_sales(spark, sf, (s.BILL_DATE, s.QUANTITY)))


@query("O1_sorted_series", sql("daily", "SELECT * FROM daily ORDER BY day"))
def sorted_series(spark, sf):
    return audit.daily_totals(canonical_sales(spark, sf, (s.BILL_DATE, s.QUANTITY))).orderBy("day")


@query("A9_date_range", sql("sales", "SELECT CAST(min(BillDate) AS DATE) AS first_day, CAST(max(BillDate) AS DATE) AS last_day FROM sales"))
def date_range(spark, sf):
    span = audit.date_range(canonical_sales(spark, sf, (s.BILL_DATE,)))
    return span.select(day(F.col("date_min")).alias("first_day"), day(F.col("date_max")).alias("last_day"))


@query(
    "A10_duplicates",
    sql(
        "upload",
        """
SELECT n AS original_rows, d AS rows_after_dedupe, n - d AS duplicates_removed
FROM (SELECT count(*) AS n FROM upload) AS a CROSS JOIN (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM upload) AS u) AS b
""".replace("DISTINCT *", f"DISTINCT {COMPARED}, td_raw, emi_raw, cashback_raw, scheme_raw"),
    ),
)
def duplicates(spark, sf):
    return audit.duplicate_counts(uploaded_sales(spark, sf))


@query(
    "U1_distinct",
    rounded(
        "upload",
        f"""
SELECT CAST(BillDate AS DATE) AS bill_day, count(*) AS "rows", sum(Quantity) AS Quantity
FROM (SELECT DISTINCT {COMPARED}, td_raw, emi_raw, cashback_raw, scheme_raw FROM upload) AS u GROUP BY 1
""",
        "Quantity",
    ),
)
def distinct(spark, sf):
    rows = dedupe(uploaded_sales(spark, sf))
    return rows.groupBy(day(F.col(s.BILL_DATE)).alias("bill_day")).agg(
        F.count("*").alias("rows"), F.sum(s.QUANTITY).alias(s.QUANTITY)
    )


@query(
    "J9_new_rows",
    rounded(
        "added",
        "SELECT * REPLACE (CAST(BillDate AS DATE) AS BillDate) FROM added",
        "MRP ProductLevelDiscAmount",
        4,
    ),
    digits=4,
)
def new_rows(spark, sf):
    rows = audit.new_rows(uploaded_sales(spark, sf, s.REQUIRED), active_sales(spark, sf))
    return rows.withColumn(s.BILL_DATE, day(F.col(s.BILL_DATE)))


@query("J9_new_row_count", sql("added", "SELECT count(*) AS rows_added FROM added"))
def new_row_count(spark, sf):
    rows = audit.new_rows(uploaded_sales(spark, sf, s.REQUIRED), active_sales(spark, sf))
    return rows.agg(F.count("*").alias("rows_added"))


def _digests(spark, sf):
    """Digests of the active sales in two generations, as two uploads leave them."""
    kept = SalesDigests(spark, f"{shared_dir(spark)}/shelfcast/digests-{uuid.uuid4().hex}")
    sales = active_sales(spark, sf)
    for part in (F.col(s.BILL_DATE) < "1999-01-01", F.col(s.BILL_DATE) >= "1999-01-01"):
        kept.append(sales.where(part))
    return kept


@query(
    "J9_new_rows_by_digest",
    rounded("added", "SELECT * REPLACE (CAST(BillDate AS DATE) AS BillDate) FROM added", "MRP ProductLevelDiscAmount", 4),
    digits=4,
)
def new_rows_by_digest(spark, sf):
    rows = _digests(spark, sf).new_rows(uploaded_sales(spark, sf, s.REQUIRED))
    return rows.withColumn(s.BILL_DATE, day(F.col(s.BILL_DATE)))


@query(
    "U2_except",
    sql(
        "upload active",
        """
SELECT StoreName, ProductName, CAST(BillDate AS DATE) AS "BillDate" FROM upload
EXCEPT SELECT StoreName, ProductName, CAST(BillDate AS DATE) FROM active
""",
    ),
)
def except_rows(spark, sf):
    columns = (*s.PAIR, s.BILL_DATE)
    rows = audit.new_rows(uploaded_sales(spark, sf, columns), active_sales(spark, sf, columns), columns)
    return rows.select(*s.PAIR, day(F.col(s.BILL_DATE)).alias(s.BILL_DATE))


@query(
    "J10_missing_dates",
    sql(
        "store_daily",
        """
SELECT f.StoreName, f.day AS missing_date
FROM (SELECT StoreName, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
      FROM store_daily GROUP BY 1) f
LEFT JOIN store_daily o ON f.StoreName = o.StoreName AND f.day = o.day WHERE o.day IS NULL
""",
    ),
)
def missing_dates(spark, sf):
    return audit.missing_dates(canonical_sales(spark, sf, DAILY), keys=(s.STORE,))


_LIMIT = """greatest(quantile_cont(abs(change), 0.9), avg(Quantity) * 0.5::DOUBLE, 1)"""


@query(
    "A11_change_threshold",
    rounded("changes", f"SELECT {_LIMIT} AS threshold FROM changes", "threshold"),
)
def change_threshold(spark, sf):
    return audit.change_threshold(audit.daily_changes(canonical_sales(spark, sf, (s.BILL_DATE, s.QUANTITY))))


@query(
    "A11_change_threshold_by_store",
    rounded("store_changes", f"SELECT StoreName, {_LIMIT} AS threshold FROM store_changes GROUP BY 1", "threshold"),
)
def change_threshold_by_store(spark, sf):
    keys = (s.STORE,)
    return audit.change_threshold(audit.daily_changes(canonical_sales(spark, sf, DAILY), keys), keys)


@query("W8_daily_changes", rounded("changes", "SELECT * FROM changes", "pct_change"))
def daily_changes(spark, sf):
    return audit.daily_changes(canonical_sales(spark, sf, (s.BILL_DATE, s.QUANTITY)))


_JUDGED = """
SELECT {keys}day AS "Date", CASE WHEN change > 0 THEN 'Spike' ELSE 'Drop' END AS "Type",
       CAST(trunc(Quantity) AS BIGINT) AS Quantity, CAST(trunc(previous) AS BIGINT) AS "Previous",
       CAST(trunc(change) AS BIGINT) AS "Change"
FROM {table} JOIN (SELECT {keys}{limit} AS threshold FROM {table} {group}) AS t{using}
WHERE abs(change) >= threshold AND abs(pct_change) >= 0.5
"""


@query(
    "W9_sudden_changes",
    sql("changes", _JUDGED.format(keys="", table="changes", limit=_LIMIT, group="", using=" ON TRUE")),
)
def sudden_changes(spark, sf):
    return audit.sudden_changes(canonical_sales(spark, sf, (s.BILL_DATE, s.QUANTITY)))


@query(
    "W9_sudden_changes_by_store",
    sql(
        "store_changes",
        _JUDGED.format(
            keys="StoreName, ", table="store_changes", limit=_LIMIT, group="GROUP BY StoreName", using=" USING (StoreName)"
        ),
    ),
)
def sudden_changes_by_store(spark, sf):
    return audit.sudden_changes(canonical_sales(spark, sf, DAILY), keys=(s.STORE,))


_UPLOAD_DAYS = f"""
SELECT day, Quantity, lag(Quantity) OVER (ORDER BY day) AS previous, Quantity - lag(Quantity) OVER (ORDER BY day) AS change
FROM (SELECT CAST(BillDate AS DATE) AS day, sum(Quantity) AS Quantity
      FROM (SELECT DISTINCT {COMPARED}, td_raw, emi_raw, cashback_raw, scheme_raw FROM upload) AS u GROUP BY 1) AS d
"""


_AUDIT = sql(
        "added",
        f"""
SELECT n AS original_rows, d AS rows_after_dedupe, (SELECT count(*) FROM added) AS rows_added,
       n - d AS duplicates_removed, first_day AS date_min, last_day AS date_max,
       (last_day - first_day + 1) - days AS missing_dates, anomalies
FROM (SELECT count(*) AS n, CAST(min(BillDate) AS DATE) AS first_day, CAST(max(BillDate) AS DATE) AS last_day,
             count(DISTINCT CAST(BillDate AS DATE)) AS days FROM upload) AS a
CROSS JOIN (SELECT count(*) AS d
            FROM (SELECT DISTINCT {COMPARED}, td_raw, emi_raw, cashback_raw, scheme_raw FROM upload) AS u) AS b
CROSS JOIN (
  SELECT count(*) AS anomalies FROM ({_UPLOAD_DAYS}) AS c
  CROSS JOIN (SELECT {_LIMIT} AS threshold FROM ({_UPLOAD_DAYS}) AS e) AS t
  WHERE abs(change) >= threshold AND abs(change / nullif(previous, 0)) >= 0.5) AS z
""",
    )


@query("R2_upload_audit", _AUDIT)
def upload_audit(spark, sf):
    row = audit.upload_summary(uploaded_sales(spark, sf), active_sales(spark, sf))
    return row.withColumns({c: day(F.col(c)) for c in ("date_min", "date_max")})


@query("R2_upload_audit_by_digest", _AUDIT)
def upload_audit_by_digest(spark, sf):
    """As above, without reading the active sales."""
    row = audit.upload_summary(uploaded_sales(spark, sf), digests=_digests(spark, sf))
    return row.withColumns({c: day(F.col(c)) for c in ("date_min", "date_max")})
