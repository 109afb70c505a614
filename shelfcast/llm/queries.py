"""The operators over the given tables, each with its production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import fingerprints, jaccard, languages, licences, mixing, neardup, pieces, quality, rules, secrets, sharding, trie, whitening
from shelfcast.llm.common import remainder, word_count
from shelfcast.session import materialize

#: The vocabulary file of op8_pieces; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_languages")
def op1_languages(spark, sf_dir):
    """Learns from documents whose remainder by 5 is not 0; a null id is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    model = languages.fit(docs.where(~held_out), "text", "lang", "doc_id")
    return languages.predict(model, docs, "doc_id", "text", held_out)


@query("op3_mixing", mixing.ORACLE_SQL)
def op3_mixing(spark, sf_dir):
    """Sizes are written once, so that the texts are read once."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    names = ("doc_id", "size", "source_size", "target", "copies", "taken", "first_position", "last_position")
    return mixing.mix(sized).select(*names)


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op4_fingerprints")
def op4_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def quality_network(docs: DataFrame, labels: DataFrame) -> quality.Network:
    """Learns from labelled documents whose remainder by 3 is not 1."""
    return quality.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    network = quality_network(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(network, docs.select("doc_id", "text"))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_jaccard")
def op6_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_secrets")
def op10_secrets(spark, sf_dir):
    return secrets.find(table(spark, sf_dir, "documents"))


@query("op8_pieces")
def op8_pieces(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"), pieces.load(VOCABULARY))


@query("op2_neardup")
def op2_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_licences")
def op7_licences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licences.find(docs, licences.fit(spark, docs))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


@query("op12_rules", rules.ORACLE_SQL)
def op12_rules(spark, sf_dir):
    """Counts are written once, so that the texts are read once."""
    return rules.apply_rules(table(spark, sf_dir, "documents"))


@query("op13_trie", trie.ORACLE_SQL)
def op13_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
