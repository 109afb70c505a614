"""Reading sales and side tables; writing snapshots and reports."""

import datetime
import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schema as s
from shelfcast.functions.text import clean_double
from shelfcast.sources.files import exists

LOG = logging.getLogger(__name__)


def read_header(spark: SparkSession, path: str, *, fmt: str = "parquet") -> list[str]:
    """Column names without reading any rows."""
    if fmt == "csv":
        return spark.read.option("header", True).csv(path).columns
    return spark.read.format(fmt).load(path).columns


def read_sales(
    spark: SparkSession, path: str, *, fmt: str = "parquet", columns: Sequence[str] | None = None
) -> DataFrame:
    """Sales with the known columns that the file has; other columns are left alone in the file.

    The schema is fixed: columns of other types are cast. Dates stay text until ``parse_bill_date`` if they are text in
    the file, so that a bad one is dropped and not an error. Nulls replace NaN.
    """
    header = read_header(spark, path, fmt=fmt)
    known = [f for f in s.SALES_SCHEMA if f.name in header]
    wanted = [f.name for f in known if columns is None or f.name in columns]
    if fmt == "csv":
        types = {f.name: T.StringType() if f.name == s.BILL_DATE else f.dataType for f in known}
        schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        sales = spark.read.option("header", True).schema(schema).csv(path)
    else:
        stored = spark.read.format(fmt).load(path)
        text_dates = isinstance(stored.schema[s.BILL_DATE].dataType, T.StringType) if s.BILL_DATE in stored.columns else False
        kept = [f for f in known if not (f.name == s.BILL_DATE and text_dates)]
        sales = stored.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in kept})
    numeric = {f.name for f in sales.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return sales.select(*[clean_double(F.col(c)).alias(c) if c in numeric else F.col(c) for c in wanted])


def read_history(spark: SparkSession, path: str, *, fmt: str = "parquet") -> DataFrame:
    """The columns a forecast needs: keys, date, quantity and the optional ones that the file has."""
    return read_sales(
        spark, path, fmt=fmt, columns=(s.REGION, s.STORE, s.PRODUCT, s.BILL_DATE, s.QUANTITY, *s.OPTIONAL)
    )


def read_side_tables(
    spark: SparkSession, paths: Mapping[str, str], *, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """The side tables whose file exists, with their columns found by name and cast.

    An absent table is skipped; one that lacks a column is logged and skipped, so the others still join. Values that
    cannot be cast are null.
    """
    found = {}
    for name, path in paths.items():
        if not exists(spark, path):
            continue
        table = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
        wanted = T.StructType.fromDDL(s.SIDE_TABLES[name])
        if missing := [f.name for f in wanted if f.name not in table.columns]:
            LOG.warning("side table %s left out: no column %s", name, ", ".join(missing))
            continue
        found[name] = table.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])
    return found


def write_snapshot(sales: DataFrame, root: str, *, when: datetime.datetime | None = None) -> str:
    """Keep the rows a model is trained on; returns their folder."""
    stamp = (when or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{root.rstrip('/')}/training_uploads/run={stamp}"
    sales.write.parquet(path)
    return path


def write_report_csv(report: DataFrame, path: str, *, by: str | None = None) -> None:
    """CSV files with a header, one folder per value of ``by`` if given."""
    writer = report.write.mode("overwrite").option("header", True)
    if by is not None:
        writer = writer.partitionBy(by)
    writer.csv(path)
