"""Sorted label codes and their lookup."""

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.session import materialize


def label_codes(labels: DataFrame) -> DataFrame:
    """Codes 0..n-1 of the sorted distinct labels of each kind, without sorting them in one task.

    ``labels`` has the columns ``kind`` and ``label``. The distinct labels are range-partitioned and written
    with the number of their range. A label's code is the number of its kind's labels in earlier ranges plus
    its place in its own range; only the range sizes, a few per range, are summed in one task.
    """
    distinct = labels.select("kind", "label").where(F.col("label").isNotNull()).distinct()
    ranged = materialize(
        distinct.repartitionByRange("kind", "label").withColumn("_range", F.spark_partition_id()), "label-ranges"
    )
    sizes = ranged.groupBy("kind", "_range").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy("kind").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("kind", "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("kind", "_range").orderBy("label")) - 1
    return materialize(
        ranged.join(offsets, ["kind", "_range"]).select(
            "kind", "label", (F.col("_offset") + place).cast("long").alias("code")
        ),
        "label-codes",
    )


def as_labels(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The given columns as (kind, label) rows."""
    listed = [F.struct(F.lit(kind).alias("kind"), c.alias("label")) for kind, c in columns.items()]
    return df.select(F.inline(F.array(*listed)))


def _lookup(codes: DataFrame, kind: str, label: str, code: str) -> DataFrame:
    return codes.where(F.col("kind") == kind).select(F.col("label").alias(label), F.col("code").alias(code))


def composite(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


@dataclass
class Encoders:
    """Lookup tables of the five label codes. The last two may be absent."""

    region: DataFrame
    store: DataFrame
    product: DataFrame
    product_store: DataFrame | None = None
    month_product: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        named = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: table for name, table in named.items() if table is not None}


def fit_encoders(panel: DataFrame) -> Encoders:
    """Codes of regions, stores and products, and of their combinations as texts.

    ``panel`` needs the series keys and ``Month``.
    """
    combos = materialize(panel.select(*s.SERIES, "Month").distinct(), "label-combinations")
    base = label_codes(as_labels(combos, {c: F.col(c) for c in s.SERIES}))
    region = _lookup(base, s.REGION, s.REGION, "RegionID")
    store = _lookup(base, s.STORE, s.STORE, "StoreID")
    product = _lookup(base, s.PRODUCT, s.PRODUCT, "ProductID")
    combined = label_codes(
        as_labels(
            combos.join(store, s.STORE).join(product, s.PRODUCT),
            {
                "product_store": composite(F.col("ProductID"), F.col("StoreID")),
                "month_product": composite(F.col("Month"), F.col("ProductID")),
            },
        )
    )
    return Encoders(
        region,
        store,
        product,
        _lookup(combined, "product_store", "Product_Store_Combo", "Product_Store_ID"),
        _lookup(combined, "month_product", "Month_Product", "Month_Product_ID"),
    )


def encode_base(df: DataFrame, enc: Encoders) -> DataFrame:
    """Add the three base codes; an unseen label has a null code."""
    return df.join(enc.region, s.REGION, "left").join(enc.store, s.STORE, "left").join(enc.product, s.PRODUCT, "left")


def encode(df: DataFrame, enc: Encoders) -> DataFrame:
    """Add all five codes. Unseen labels have null base codes; unseen combinations have code 0."""
    coded = encode_base(df, enc).withColumns(
        {
            "Product_Store_Combo": composite(F.col("ProductID"), F.col("StoreID")),
            "Month_Product": composite(F.col("Month"), F.col("ProductID")),
        }
    )
    for table, key, code in (
        (enc.product_store, "Product_Store_Combo", "Product_Store_ID"),
        (enc.month_product, "Month_Product", "Month_Product_ID"),
    ):
        if table is None:
            coded = coded.withColumn(code, F.lit(0).cast("long"))
        else:
            coded = coded.join(table, key, "left").withColumn(code, F.coalesce(code, F.lit(0)))
    return coded
