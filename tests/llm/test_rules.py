"""Quality rules: counts against plain loops, thresholds against exact quartiles, and what they keep."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.llm import rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    repeats = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), symbols, repeats, len(inside), len(lines)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é😀\n\t\x0b\x1c\x85\xa0#|", max_size=60))
def test_counts_of_any_text(text):
    assert rules.measures(text.encode()) == brute(text)


def test_buckets_hold_their_values(spark):
    values = [0, 1, 127, 128, 129, 255, 256, 257, 1000, 999_999, 1_000_000, 2**40 + 12345]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    got = rows.select("v", rules.bucket(F.col("v")).alias("b"), rules.bucket_top(rules.bucket(F.col("v"))).alias("top")).orderBy("v").collect()
    assert [r.b for r in got] == sorted(r.b for r in got)
    assert all(r.v <= r.top <= r.v * (1 + 2.0**-rules.BITS) + 1 for r in got)
    assert all(r.v == r.top for r in got if r.v < 256)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abdeimnorstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    long_words = [w + w for w in words]
    rows = [(i, prose(rng, rng.randint(60, 200), words), "en", rng.choice(("a", "a", "b", None))) for i in range(400)]
    rows += [(1000 + i, prose(rng, 120, long_words), "de", "a") for i in range(200)]
    rows += [(2000 + i, " | ".join(prose(rng, 100, words).split()), "en", "a") for i in range(40)]
    rows += [(3000 + i, "\n".join(rng.choice([prose(rng, 6, words)] * 1 + ["same old line of text here"] * 9) for _ in range(40)), "en", "b") for i in range(10)]
    rows += [(4000, None, "en", "a"), (4001, "", None, None), (4002, "few words", "fr", "c"), (4003, prose(rng, 90, words), None, None)]
    rows += [(4004, "word " * 100_000, "en", "a"), (4005, prose(rng, 100_000, words), "en", "a"), (None, rows[0][1], "en", "a"), rows[1], rows[1]]
    return rows


def test_rules(spark, corpus):
    out = rules.apply_rules(make(spark, corpus).repartition(5)).collect()
    assert len(out) == len(corpus)
    texts = {i: t for i, t, _, _ in corpus}
    small = [r for r in out if r.doc_id not in (4004, 4005)]
    for r in small:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])[:5]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in [*range(400), *range(1000, 1200), None, 4003])  # each language by its own lengths
    assert not any(kept[i] for i in [*range(2000, 2040), *range(3000, 3010), 4000, 4001, 4002, 4004])
    assert next(r for r in out if r.doc_id == 4004).n_repeat_words == 100_000
    assert sum(r.doc_id == 1 for r in out) == 3


def test_sketches_merge_whatever_the_partitions(spark, corpus):
    measured = rules.measure(make(spark, corpus))
    halves = [rules.sketches(measured.where(F.pmod("doc_id", F.lit(2)) == k)) for k in (0, 1)]
    both = rules.merge(halves[0].union(halves[1]), "lang_key", "source_key")
    whole = rules.sketches(measured.where("doc_id IS NOT NULL").repartition(7))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))


def test_quartiles_are_those_of_the_rows(spark):
    """One source to a language: the prior changes nothing, and quartiles are exact up to the bucket."""
    rows = [(i, " ".join(["abcdefghij"[: 2 + i % 7]] + [f"w{i}x{k}" for k in range(59)]), "en", "a") for i in range(101)]
    measured = rules.measure(make(spark, rows))
    limits = rules.thresholds(rules.sketches(measured)).first()
    lengths = sorted(r.word_chars * 1000 // r.n_words for r in measured.collect())
    q1, q3 = lengths[25], lengths[75]
    assert limits.length_high == pytest.approx(q3 + 3 * max(q3 - q1, 700), rel=0.03)
    assert limits.symbols_high == 3 * 15_000 and limits.lines_high == 3 * 120_000


def test_no_rows(spark):
    assert rules.apply_rules(make(spark, [])).collect() == []
