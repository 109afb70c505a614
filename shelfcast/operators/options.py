"""Choices offered to the user."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schema as s


def options(sales: DataFrame) -> DataFrame:
    """Sorted distinct regions, stores and products as (kind, value), from one scan."""
    listed = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in s.SERIES])
    return sales.select(F.inline(listed)).where(F.col("value").isNotNull()).distinct().orderBy("kind", "value")


def stores_of_regions(sales: DataFrame) -> DataFrame:
    return sales.select(s.REGION, s.STORE).dropna().distinct().orderBy(s.REGION, s.STORE)


def products_of_stores(sales: DataFrame) -> DataFrame:
    """Products sold in a store, whatever the region."""
    return sales.select(s.STORE, s.PRODUCT).dropna().distinct().orderBy(s.STORE, s.PRODUCT)


def cascade(sales: DataFrame) -> DataFrame:
    """Every selectable (region, store, product): stores of the region, products of the store."""
    triples = sales.select(*s.SERIES)
    stores = triples.select(s.REGION, s.STORE).dropna().distinct()
    products = triples.select(s.STORE, s.PRODUCT).dropna().distinct()
    return stores.join(products, s.STORE).select(*s.SERIES)
