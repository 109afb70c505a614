"""Column helpers that several operators share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows chosen by a hash of their key: the same rows on every run and cluster.

    All rows if there are no more than ``bound``. Used to fit classifiers only.
    """
    n = rows.count()
    if n <= bound:
        return rows
    steps = 1 << 20
    return rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(steps)) < int(steps * bound / n))
