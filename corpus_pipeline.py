"""The training-data pipeline over ``documents``, and the queries of the subpackage ``llm``.

Every stage takes (spark, docs, sf_dir). All but the last return rows of documents with the input's columns.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import jaccard, mixing, pieces, quality, secrets
from shelfcast.llm.common import word_count
from shelfcast.llm.queries import ORACLES, QUERIES, VOCABULARY, quality_network, table
from shelfcast.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores under 0.5."""
    network = quality_network(docs, table(spark, sf_dir, "labels"))
    return quality.score(network, docs, out="_score").where(F.col("_score") >= 0.5).drop("_score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, one row stays: the smallest id (null last), then the first row written.

    Rows are told apart by a written number, so copies with one id or none are copies too, and an id that occurs with two
    texts loses only the copy. Rows without words are no copies and stay.
    """
    at = "_row__"
    numbered = materialize(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    found = jaccard.near_duplicates(numbered.select(at, "text"), id_col=at).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias(at), F.col("component_id").alias("_component__"))
    ids = numbered.select(at, F.struct(F.col("doc_id").isNull(), "doc_id", at).alias("_order__"))
    members = materialize(ids.join(found, at), "members")
    first = members.groupBy("_component__").agg(F.min("_order__").alias("_order__"))
    stay = first.select(F.col(f"_order__.{at}").alias(at))
    gone = members.select(at).join(stay, at, "left_anti")
    return numbered.join(gone, at, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found spans are masked, and n_chars follows the text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it (not at all to twice). Only the copies are sorted."""
    mixed = mixing.mix(docs.withColumn("words__", word_count(F.col("text"))), size_col="words__", ordered=False)
    return mixing.training_rows(mixed, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, pieces.load(VOCABULARY))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: The stages need trained models, shingle sets and a lattice search: no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {**QUERIES, "pipeline": run}

__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]
