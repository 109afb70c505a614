"""Secrets in texts: fixed patterns, and a battery of randomness tests under false-discovery control.

Column expressions only. The patterns give the base spans. Runs of at least ``SHORTEST`` token characters that overlap
none of them are candidates. A candidate's encoding is the smallest alphabet that holds it. Three tests ask whether its
characters are even over the alphabet (chi-squared), change sides of the alphabet's middle as often as chance has it
(runs), and ignore their predecessor (serial correlation). A candidate that no test rejects gets a p-value: the chance
that natural text of its length is as even as it is, where natural text is as uneven as the letters of the corpus's
ordinary words are: the median over the documents, so that each counts once, whatever it holds. Discoveries are chosen per class of length by Benjamini and Hochberg's rule, from counts
of p-values in bins, so that short strings, which the tests tell apart badly, need not pay for long ones nor the reverse.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialize

#: The base patterns, in the order of their kinds.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]+", 32),
)
#: Runs equal those of the base pattern when cut by its shortest length; sought in texts where the plain ones are everywhere.
LONG = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
SHORTEST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings from the smallest alphabet up; a candidate of the first three alone is a word or a number.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("number", DIGITS), ("word", LOWER), ("word", UPPER),
    ("hex", DIGITS + "abcdef"), ("hex", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER), ("base36", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Level of each test; false-discovery rate; sum of squared letter shares of natural text, which counts as many pairs of
#: letters as 100 letters have in every document.
LEVEL, RATE, NATURAL, PRIOR = 0.001, 0.01, 0.065, 100 * 99
BINS, PER_DECADE, SHARES = 600, 20, 10_000
MASK = "[secret]"
#: Matches that are gone through one by one; longer lists are gone through block by block.
BLOCK = 128


def _let(value: str, name: str, then: str) -> str:
    """SQL: ``then``, in which ``name`` is the value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _blocks(items: str) -> str:
    """SQL: an array in blocks of ``BLOCK`` items; an array that grows item by item is copied at each step, a block is short."""
    return _let(items, "l", f"transform(IF(size(l) > 0, sequence(0, (size(l) - 1) div {BLOCK}), CAST(array() AS array<bigint>)), i -> slice(l, CAST(i * {BLOCK} + 1 AS INT), {BLOCK}))")


def _places(text: str, pattern: str) -> str:
    """SQL: array of (start, match) of a pattern's matches in a column, by the lengths of matches and of the gaps between
    them: sums inside blocks of matches, then sums of blocks."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{quoted}', 0)"
    pairs = _let(found, "f", f"zip_with(slice(split({text}, '{quoted}', -1), 1, size(f)), f, (g, m) -> named_struct('g', length(g), 'm', m))")
    none = "CAST(array() AS array<struct<s:int,m:string>>)"
    inside = f"""transform({_blocks(pairs)}, b -> aggregate(b, named_struct('at', 0, 'out', {none}),
        (a, x) -> named_struct('at', a.at + x.g + length(x.m), 'out', concat(a.out, array(named_struct('s', a.at + x.g, 'm', x.m))))))"""
    offsets = "aggregate(k, named_struct('at', 0, 'out', CAST(array() AS array<int>)), (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(a.at))))"
    return _let(inside, "k", f"flatten(zip_with(k, {offsets}.out, (b, o) -> transform(b.out, x -> named_struct('s', x.s + o, 'm', x.m))))")


_EMPTY = "CAST(array() AS array<struct<kind:string,rank:int,start:int,stop:int>>)"


def _unevenness(text: str) -> str:
    """SQL: sum of squared letter shares, in steps of 1 / SHARES, of the letters outside candidates; null under two letters."""
    counts = f"""transform(array(regexp_replace(lower({text}), '(?i){CANDIDATE}', ' ')),
        t -> transform(split('{','.join(LOWER)}', ','), z -> CAST(octet_length(t) - octet_length(replace(t, z, '')) AS DOUBLE)))"""
    sums = f"transform({counts}, c -> named_struct('n', aggregate(c, 0D, (a, x) -> a + x), 'q', aggregate(c, 0D, (a, x) -> a + x * x)))"
    share = f"(x.q - x.n + {NATURAL}D * {PRIOR}) / (x.n * (x.n - 1) + {PRIOR})"
    return f"element_at(transform({sums}, x -> CASE WHEN x.n >= 2 THEN CAST(round({share} * {SHARES}) AS INT) END), 1)"


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _base (spans of the patterns), _candidates (start, stop, and what the tests need) and _uneven."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("_uneven", F.expr(_unevenness("_text")))
    spans = []
    for rank, (kind, pattern, least) in enumerate(PATTERNS):
        sought = LONG.get(kind, pattern)
        quoted = sought.replace("\\", "\\\\").replace("'", "\\'")
        length = "length(x.m)"
        if kind == "assign":
            length = f"length(regexp_extract(x.m, '{quoted}', 2))"
        found = f"""transform(filter({_places('_text', sought)}, x -> {length} >= {least}),
            x -> named_struct('kind', '{kind}', 'rank', {rank}, 'start', x.s, 'stop', x.s + length(x.m)))"""
        spans.append(f"CASE WHEN rlike(_text, '{quoted}') THEN {found} ELSE {_EMPTY} END")
    df = df.withColumn("_base", F.expr(f"array_sort(concat({', '.join(spans)}), (l, r) -> CASE WHEN l.start != r.start THEN l.start - r.start ELSE l.rank - r.rank END)"))
    # Base spans by blocks with their extent, so that a candidate is held against those near it.
    df = df.withColumn("_near", F.expr(f"transform({_blocks('_base')}, b -> named_struct('lo', b[0].start, 'hi', array_max(transform(b, x -> x.stop)), 'spans', b))"))
    df = df.withColumn(
        "_runs",
        F.expr(
            f"""CASE WHEN rlike(_text, '{CANDIDATE}') THEN
            filter({_places('_text', CANDIDATE)}, c -> NOT exists(_near, k -> c.s < k.hi AND c.s + length(c.m) > k.lo
                AND exists(k.spans, b -> c.s < b.stop AND c.s + length(c.m) > b.start)))
            ELSE CAST(array() AS array<struct<s:int,m:string>>) END"""
        ),
    )
    encodings = " ".join(f"WHEN length(translate(c.m, '{a}', '')) = 0 THEN named_struct('e', '{e}', 'a', '{a}')" for e, a in ENCODINGS)
    df = df.withColumn(
        "_runs", F.expr(f"transform(_runs, c -> named_struct('s', c.s, 'm', c.m, 'n', length(c.m), 'e', CASE {encodings} END, 'c', split(c.m, '')))")
    )
    # Places of the characters in the alphabet, and the sum of squared counts.
    df = df.withColumn(
        "_runs",
        F.expr(
            """transform(_runs, c -> named_struct('s', c.s, 'n', c.n, 'e', c.e.e, 'k', length(c.e.a),
            'v', transform(filter(c.c, z -> z != ''), z -> CAST(instr(c.e.a, z) AS DOUBLE)),
            'q', aggregate(array_distinct(c.c), 0D, (t, z) -> t + IF(z = '', 0D, pow(c.n - length(replace(c.m, z, '')), 2)))))"""
        ),
    )
    df = df.withColumn(
        "_runs",
        F.expr(
            """transform(_runs, c -> named_struct('s', c.s, 'n', c.n, 'e', c.e, 'k', c.k, 'q', c.q,
            'hi', size(filter(c.v, x -> 2 * x > c.k + 1)),
            'turns', 1 + aggregate(zip_with(slice(c.v, 1, c.n - 1), slice(c.v, 2, c.n - 1), (x, y) -> IF((2 * x > c.k + 1) != (2 * y > c.k + 1), 1, 0)), 0, (t, x) -> t + x),
            'mean', aggregate(c.v, 0D, (t, x) -> t + x) / c.n, 'v', c.v))"""
        ),
    )
    return df.withColumn(
        "_candidates",
        F.expr(
            """transform(_runs, c -> named_struct('start', c.s, 'stop', c.s + c.n, 'n', c.n, 'e', c.e, 'k', c.k, 'q', c.q, 'hi', c.hi, 'turns', c.turns,
            'serial', aggregate(zip_with(slice(c.v, 1, c.n - 1), slice(c.v, 2, c.n - 1), (x, y) -> (x - c.mean) * (y - c.mean)), 0D, (t, x) -> t + x)
                / greatest(aggregate(c.v, 0D, (t, x) -> t + pow(x - c.mean, 2)), 1e-9D)))"""
        ),
    ).drop("_runs", "_near", "_text")


def _upper(z: str) -> str:
    """SQL: upper tail of the normal distribution (Abramowitz and Stegun 26.2.17 for |z|), kept above 0."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    series = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    tail = f"exp(-pow({z}, 2) / 2) / {math.sqrt(2 * math.pi)!r}D * {series}"
    return f"greatest(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END, 1e-30D)"


def _tested(natural: float) -> Column:
    """Candidates that no test rejects, with the bin of their p-value and their class of length."""
    chi = "(c.k * c.q / c.n - c.n)"
    spread = "sqrt(2D * (c.k - 1) * (c.n - 1) / c.n)"
    expected = "(1 + 2D * c.hi * (c.n - c.hi) / c.n)"
    deviation = "sqrt(greatest(2D * c.hi * (c.n - c.hi) * (2D * c.hi * (c.n - c.hi) - c.n) / (pow(c.n, 2) * (c.n - 1)), 1e-9D))"
    excess = f"(c.k * greatest({natural!r}D, 2D / c.k) - 1)"
    even = f"(({chi} - (c.k - 1) - (c.n - 1) * {excess}) / sqrt(2D * (c.k - 1) + 4D * (c.n - 1) * {excess}))"
    passed = f"""c.e NOT IN ('number', 'word') AND {_upper(f'({chi} - (c.k - 1)) / {spread}')} >= {LEVEL}
        AND 2 * {_upper(f'abs(c.turns - {expected}) / {deviation}')} >= {LEVEL}
        AND 2 * {_upper('abs(c.serial) * sqrt(c.n)')} >= {LEVEL}"""
    p = _upper(f"-{even}")
    return F.expr(
        f"""transform(filter(_candidates, c -> {passed}), c -> named_struct('start', c.start, 'stop', c.stop,
        'len', CAST(floor(log2(c.n)) AS INT), 'bin', CAST(least(floor(-log10({p}) * {PER_DECADE}), {BINS}) AS INT)))"""
    )


def thresholds(spanned: DataFrame) -> tuple[float, dict[int, int]]:
    """Unevenness of natural text, and per class of length the lowest accepted bin.

    Counts over the candidates of all documents, words and numbers aside; the driver reads the counts per
    (class, bin), at most 40 x 601 rows, and of documents per step of unevenness, at most SHARES + 1 rows.
    """
    natural = _median({r["_uneven"]: r["count"] for r in spanned.where("_uneven IS NOT NULL").groupBy("_uneven").count().collect()})
    each = spanned.select(F.explode("_candidates").alias("c"))
    totals = each.where("c.e NOT IN ('word', 'number')").groupBy(F.expr("CAST(floor(log2(c.n)) AS INT)").alias("len")).count()
    counts: dict[int, dict[int, int]] = {}
    for r in spanned.select(F.explode(_tested(natural)).alias("t")).groupBy("t.len", "t.bin").count().collect():
        counts.setdefault(r["len"], {})[r["bin"]] = r["count"]
    return natural, _accepted(counts, {r["len"]: r["count"] for r in totals.collect()})


def _median(steps: dict[int, int]) -> float:
    """Lower median of the documents' unevenness; NATURAL without any letters."""
    seen, half = 0, sum(steps.values()) / 2
    for step in sorted(steps):
        seen += steps[step]
        if seen >= half:
            return step / SHARES
    return NATURAL


def _accepted(counts: dict[int, dict[int, int]], totals: dict[int, int]) -> dict[int, int]:
    """Benjamini and Hochberg's rule on bins: the lowest bin whose largest p-value is within RATE * rank / tests."""
    out = {}
    for length, bins in counts.items():
        rank = 0
        for b in sorted(bins, reverse=True):
            rank += bins[b]
            if 10.0 ** (-b / PER_DECADE) <= RATE * rank / totals[length]:
                out[length] = b
    return out


def with_found(spanned: DataFrame, chosen: tuple[float, dict[int, int]]) -> DataFrame:
    """``spanned`` with _spans: the base spans and the accepted candidates (kind "random"), by start and kind."""
    natural, lowest = chosen
    cases = " ".join(f"WHEN {length} THEN t.bin >= {b}" for length, b in lowest.items())
    extra = f"""transform(filter(_tests, t -> {f'CASE t.len {cases} ELSE false END' if cases else 'false'}),
        t -> named_struct('kind', 'random', 'rank', {len(PATTERNS)}, 'start', t.start, 'stop', t.stop))"""
    order = "(l, r) -> CASE WHEN l.start != r.start THEN l.start - r.start ELSE l.rank - r.rank END"
    return spanned.withColumn("_tests", _tested(natural)).withColumn("_spans", F.expr(f"array_sort(concat(_base, {extra}), {order})")).drop("_tests")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    A span is kind:start:end of a match in code points, end exclusive. Null and empty texts have none (the hash is that
    of the empty string); null and repeated ids are rows like others; other columns are not read. The spans and the
    candidates' test values, a small part of the texts, are written once; texts are scanned once.
    """
    scanned = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    spanned = materialize(scanned, "secret-spans")
    found = with_found(spanned, thresholds(spanned))
    counts = [F.expr(f"CAST(size(filter(_spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")]
    return found.select("doc_id", *counts, F.expr(f"sha2({_joined('_base')}, 256)").alias("base_sha256"), F.expr(_joined("_spans")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``MASK``; texts without spans, and null texts, stay as they are.

    Overlapping spans are masked as one. Columns beginning with ``_`` are not kept.
    """
    columns = [c for c in docs.columns if not c.startswith("_")]
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    chosen = thresholds(materialize(with_spans(kept.select(text_col), text_col).select("_candidates", "_uneven"), "secret-candidates"))
    found = with_found(with_spans(kept, text_col), chosen)
    # A block's part of the text is cut out once; places inside it count from where the blocks before it ended.
    inside = f"""aggregate(b, named_struct('at', 0, 'from', a.at, 'out', CAST(array() AS array<string>),
            't', substring(`{text_col}`, a.at + 1, greatest(array_max(transform(b, s -> s.stop)) - a.at, 0))),
        (p, s) -> named_struct('at', greatest(p.at, s.stop - p.from), 'from', p.from,
            'out', IF(s.stop - p.from <= p.at OR s.start - p.from < p.at, p.out, concat(p.out, array(substring(p.t, p.at + 1, s.start - p.from - p.at), '{MASK}'))), 't', p.t))"""
    masked = F.expr(
        f"""aggregate({_blocks('_spans')}, named_struct('at', 0, 'out', CAST(array() AS array<string>)),
        (a, b) -> {_let(inside, 'r', "named_struct('at', a.at + r.at, 'out', concat(a.out, array(array_join(r.out, ''))))")},
        a -> concat(array_join(a.out, ''), substring(`{text_col}`, a.at + 1)))"""
    )
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, masked).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in columns])
