"""A panel that grows against the one computed at once."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators.series import series_features
from shelfcast.operators.weekly import weekly_demand
from shelfcast.plans.panel import PanelStore, grow

WEEKS = [datetime.date(2023, 3, 5), datetime.date(2023, 3, 12), datetime.date(2023, 8, 6), datetime.date(2024, 2, 4)]


@pytest.fixture
def sales(make_sales):
    """Gaps within and between the appends, series that begin late or end early, and a pair in three regions."""
    rng = random.Random(2)
    rows = []
    for region, store, product, first, last, share in (
        ("R", "A", "p", 0, 390, 0.6), ("R", "A", "q", 0, 60, 0.3), ("R", "B", "p", 150, 390, 0.05), ("S", "C", "p", 0, 390, 0.1),
        ("Q", "C", "p", 100, 390, 0.2), ("T", "C", "p", 230, 300, 0.4), ("R", "D", "p", 3, 3, 1.0),
    ):
        for day in range(first, last + 1):
            if rng.random() < share:
                when = datetime.date(2023, 1, 2) + datetime.timedelta(days=day)
                rows.append((region, store, product, when.isoformat(), float(rng.choice((-2, 0, 1, 3, 8)))))
    return make_sales(rows)


def values(frame):
    out = {}
    for r in frame.collect():
        key = tuple(r[c] for c in (*s.SERIES, s.WEEK_END))
        assert key not in out
        out[key] = {c: v for c, v in r.asDict().items() if c not in (*s.SERIES, s.WEEK_END)}
    return out


def test_appends_equal_full_recomputation(spark, sales, tmp_path):
    store = None
    for k in range(1, len(WEEKS) + 1):
        store = grow(spark, str(tmp_path / f"{k}"), sales, WEEKS[:k]) if k in (1, 4) else store
    until = sales.where(F.col(s.BILL_DATE) <= "2024-02-04")
    got, expected = values(store.read()), values(series_features(weekly_demand(until), on_zero="zero"))
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key].keys() == row.keys()
        for c, v in row.items():
            same = got[key][c] == v or (v is not None and got[key][c] is not None and math.isclose(got[key][c], v, rel_tol=1e-9, abs_tol=1e-9))
            assert same, (key, c, got[key][c], v)
    recent = values(store.read(since=WEEKS[2]))
    assert recent == {k: v for k, v in got.items() if k[3] >= WEEKS[2]}


def test_state_stays_small(spark, sales, tmp_path):
    store = grow(spark, str(tmp_path / "s"), sales, WEEKS)
    state = store._state(store.closed()[0])
    assert state.groupBy(*s.PAIR).count().where("count > 13 + 2").isEmpty()  # and the last week of two more regions


def test_closed_weeks_take_no_sales(spark, sales, tmp_path, monkeypatch):
    store = grow(spark, str(tmp_path / "c"), sales, WEEKS[:1])
    with pytest.raises(ValueError, match="too late"):
        store.append(sales, WEEKS[1])
    with pytest.raises(ValueError, match="closed"):
        store.append(sales.limit(0), WEEKS[0])
    before = values(store.read())
    monkeypatch.setattr("shelfcast.plans.panel.append_entry", lambda *a: False)
    with pytest.raises(RuntimeError, match="another writer"):
        store.append(sales.where(F.col(s.BILL_DATE) > "2023-03-05"), WEEKS[1])
    assert values(store.read()) == before and store.closed() == (1, WEEKS[0])


def test_an_append_without_sales(spark, sales, tmp_path):
    store = grow(spark, str(tmp_path / "e"), sales, WEEKS[:1])
    before = values(store.read())
    store.append(sales.limit(0), WEEKS[1])
    assert values(store.read()) == before and PanelStore(spark, str(tmp_path / "e")).closed() == (2, WEEKS[1])
