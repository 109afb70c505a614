"""Upload checks against plain Python."""

import datetime
import random

from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators import audit
from shelfcast.operators.cleaning import dedupe


def random_rows(rng, n, start, days):
    rows = []
    for _ in range(n):
        when = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=start + rng.randint(0, days))
        rows.append(("R", f"S{rng.randint(0, 2)}", rng.choice(["P", None]), when.isoformat(sep=" "), float(rng.randint(1, 40))))
    return rows


def test_summary_by_hand(make_sales):
    rng = random.Random(4)
    active = random_rows(rng, 150, 0, 40)
    upload = random_rows(rng, 150, 20, 60) + active[:30] + active[:10]
    upload += upload[:25] + [("R", "S0", "P", None, 3.0), ("R", "S0", "P", None, 3.0)]
    row = audit.upload_summary(make_sales(upload), make_sales(active)).first()

    unique = list(dict.fromkeys(upload))
    totals = {}
    for _, _, _, when, quantity in unique:
        if when is not None:
            totals[when[:10]] = totals.get(when[:10], 0.0) + quantity
    days = sorted(totals)
    changes = [totals[b] - totals[a] for a, b in zip(days, days[1:])]
    sizes = sorted(abs(c) for c in changes)
    place = 0.9 * (len(sizes) - 1)
    low = int(place)
    q90 = sizes[low] + (place - low) * (sizes[min(low + 1, len(sizes) - 1)] - sizes[low])
    limit = max(q90, 0.5 * sum(totals.values()) / len(totals), 1.0)
    sudden = [c for a, c in zip(days, changes) if abs(c) >= limit and totals[a] and abs(c / totals[a]) >= 0.5]
    span = (datetime.date.fromisoformat(days[-1]) - datetime.date.fromisoformat(days[0])).days + 1
    assert row.original_rows == len(upload)
    assert row.rows_after_dedupe == len(unique)
    assert row.duplicates_removed == len(upload) - len(unique)
    assert row.rows_added == len(set(upload) - set(active))
    assert row.missing_dates == span - len(days)
    assert row.anomalies == len(sudden)
    assert row.date_min.date().isoformat() == days[0] and row.date_max.date().isoformat() == days[-1]


def test_summary_without_active_or_dates(make_sales):
    row = audit.upload_summary(make_sales([("R", "S", "P", None, 1.0), ("R", "S", "P", None, 1.0)])).first()
    assert (row.original_rows, row.rows_after_dedupe, row.rows_added, row.missing_dates, row.anomalies) == (2, 1, 1, 0, 0)
    assert row.date_min is None


def test_summary_with_text_dates(spark):
    ddl = ", ".join(f"{c} {'double' if c in ('Quantity', 'MRP', 'ProductLevelDiscAmount') else 'string'}" for c in s.REQUIRED)
    rows = [("R", "S", "P", d, 1.0, 1.0, 0.0) for d in ("2024-01-01", "2024-01-04", "soon", "later")]
    row = audit.upload_summary(spark.createDataFrame(rows, ddl)).first()
    # Two unreadable dates are two uploaded rows, but equal once their date is gone.
    assert (row.rows_after_dedupe, row.rows_added, row.missing_dates) == (4, 3, 2)


def test_nothing_new_in_a_copy(make_sales):
    sales = make_sales(random_rows(random.Random(1), 80, 0, 10))
    assert audit.new_rows(sales, sales).count() == 0
    assert audit.new_rows(sales, None).count() == sales.distinct().count()


def test_hot_duplicate(make_sales):
    sales = make_sales([("R", "S", "P", "2024-01-01", 1.0)] * 400 + random_rows(random.Random(1), 100, 0, 10))
    row = audit.duplicate_counts(sales).first()
    assert row.original_rows == 500 and row.rows_after_dedupe == sales.distinct().count()
    once = dedupe(sales)
    assert dedupe(once).count() == once.count()


def test_missing_dates_and_spikes(make_sales):
    sales = make_sales(
        [("R", "S", "P", f"2024-01-{d:02d}", q) for d, q in ((1, 10.0), (2, 11.0), (5, 10.0), (6, 100.0), (7, 10.0))]
    )
    missing = [r.missing_date.day for r in audit.missing_dates(sales).orderBy("missing_date").collect()]
    assert missing == [3, 4]
    found = audit.sudden_changes(sales).orderBy("Date").collect()
    assert [(r.Date.day, r.Type, r.Quantity, r.Previous, r.Change) for r in found] == [
        (6, "Spike", 100, 10, 90),
        (7, "Drop", 10, 100, -90),
    ]


def test_single_day_has_no_changes(make_sales):
    sales = make_sales([("R", "S", "P", "2024-01-01", 5.0)])
    assert audit.sudden_changes(sales).count() == 0
    assert audit.change_threshold(audit.daily_changes(sales)).first()[0] == 2.5


def test_change_after_a_day_with_nothing_is_not_an_anomaly(make_sales):
    sales = make_sales([("R", "S", "P", f"2024-01-0{d}", q) for d, q in ((1, 5.0), (2, 0.0), (3, 500.0))])
    changes = audit.daily_changes(sales).orderBy("day").select("pct_change").collect()
    assert [c[0] for c in changes] == [None, -1.0, None]
    assert audit.sudden_changes(sales).where(F.col("Type") == "Spike").count() == 0
