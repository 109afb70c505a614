"""Discount, price and ratio expressions."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 1e-5
# Right-closed band edges and their labels.
DISCOUNT_EDGES, DISCOUNT_LABELS = (0.0, 0.05, 0.15, 0.3, 1.0), (0, 1, 2, 3)
OFFER_EDGES, OFFER_LABELS = (-1.0, 0.0, 2.0, 5.0, 10.0, 100.0), (0, 1, 2, 3, 4)


def band(c: Column, edges: Sequence[float], labels: Sequence[int], default: int = 0) -> Column:
    """Label of the right-closed band that holds the value; the default outside all bands and for null."""
    out = F.when(c.isNull() | (c <= edges[0]) | (c > edges[-1]), F.lit(default))
    for upper, label in zip(edges[1:], labels):
        out = out.when(c <= upper, F.lit(label))
    return out.otherwise(F.lit(default))


def discount_band(c: Column) -> Column:
    return band(c, DISCOUNT_EDGES, DISCOUNT_LABELS)


def offer_band(c: Column) -> Column:
    return band(c, OFFER_EDGES, OFFER_LABELS)


def discount_pct(amount: Column, quantity: Column, price: Column) -> Column:
    return F.coalesce(F.try_divide(amount, quantity * price + F.lit(SMALL)), F.lit(0.0))


def effective_price(price: Column, discount: Column) -> Column:
    return price * (F.lit(1.0) - discount)


def demand_ratio(true_demand: Column, quantity: Column) -> Column:
    return F.try_divide(true_demand, quantity + F.lit(SMALL))


def whole_units(c: Column) -> Column:
    """Negative totals count as none; halves go to the even neighbour."""
    return F.bround(F.greatest(c, F.lit(0.0))).cast("long")


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)
