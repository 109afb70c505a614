"""Session settings and the written intermediate tables that jobs share."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app_name: str = "shelfcast", **conf) -> SparkSession:
    """A session with adaptive execution and UTC dates; the cluster's own settings stay in force."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names, else one beside the warehouse's tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def write_table(df: DataFrame, label: str = "table") -> str:
    """Write a table to the shared folder; returns its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/shelfcast/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of ``write_table`` that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a table that several steps read, and read it back.

    The written table survives the loss of executors, lets every reader prune columns, and gives the
    planner the real size, so that it broadcasts the table only when it is small enough.
    """
    return read_table(df.sparkSession, write_table(df, label), df.schema)
