"""Near-duplicate documents: exact Jaccard join of word-shingle sets by token-combination prefixes.

A token is the 64-bit hash of a shingle. A sketch of counts over all documents splits tokens into rare and frequent.
Tokens are ordered rare first, then by hash. A document of n tokens whose partners must share t of them indexes
a prefix: single rare tokens, and, if those are too few, pairs of frequent tokens of one class. A prefix with c tokens
of a class that is indexed by k-token combinations counts c - k + 1; it is extended until the counts exceed n - t. Two
documents that share no combination then differ in more than n - t tokens, so no link is lost, however rare and
frequent are told apart. The smaller document of a pair must share even more of its tokens, so a shorter part of a
prefix of rare tokens, the index, has to meet the other's prefix.

Every class has a parity map of two to four bits per token: a bit is set if an odd number of tokens falls on it. Two
maps differ in no more bits than the sets differ in tokens, so pairs whose maps differ in too many cannot link;
the sets of the others are moved and compared. A short map of one length for all classes does the same inside the join
of the last round, before a pair becomes a row.

Documents with equal sets are one class and enter once per task. In the group of a combination, all are verified
against the smallest first. Documents that the links leave outside the smallest one's component then meet ``ANCHORS``
members of each group, and only those that are still outside meet all members of the larger groups. So a group of n near
copies costs some n verifications, not n * n, and its component is the same. What of them links with none is still
compared with all by short maps, the only step whose comparisons grow with the product of the two; pairs come of those
whose maps are close.
"""

import functools
import math
import operator
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.graph import components
from shelfcast.session import drop_table, materialize, read_table, write_table

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union.
PER_CENT = 75
#: Counters of the sketch, and rows in which they are sent and added.
COUNTERS, BLOCKS = 1 << 22, 64
#: A counter is frequent from its mean plus six deviations plus this.
FREQUENT = 64
#: A frequent class has about so many tokens of a document's size; pairs are formed inside classes.
CLASS_TOKENS = 16
#: Members of a group that those outside its main component meet before all others. Groups up to this size are done then.
ANCHORS = 16
#: 64-bit words of a short parity map.
SHORT_WORDS = 16
#: Bits of the filter that tells which documents' sets are needed to verify.
FILTER_BITS = 1 << 26
CACHE_WORDS = 100_000
#: Bytes of a text whose words are Python objects at a time, and bytes of an Arrow batch that goes back to Spark.
TEXT_BLOCK, BATCH_BYTES = 1 << 16, 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_blocks(data: bytes):
    """Words of a text, some ``TEXT_BLOCK`` bytes at a time; a block ends at white space."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, min(at + TEXT_BLOCK, len(data)))
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end + 1


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct tokens of a text: shingles of ``WORDS`` words, or its whole sequence if it has fewer.

    Lower-casing and splitting bytes touch A-Z and ASCII white space only.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    h = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) for words in word_blocks(data))])
    if not len(h):
        return h
    k = min(WORDS, len(h))
    total = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        total = total * _BASE + h[i : len(h) - k + 1 + i]
    return np.unique(mix(total + np.uint64(k)))


def set_class(tokens: np.ndarray) -> int:
    """Hash of a set, as a signed long."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def parity(tokens: np.ndarray, words: int | None = None) -> np.ndarray:
    """Parity map of a set in words of 64 bits; their number, if not given by the set's size, is a power of two. Adding the
    halves of a map (exclusive or) gives the map of half the length."""
    size = 64 * words if words else 64 << max(0, (2 * len(tokens) - 1).bit_length() - 6)
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_PROFILE = "doc_id long, cls long, n long, parity binary, short array<long>, block int, counts binary"


def _profiles(batches):
    """Class and size of each document, then the task's counters."""
    hashes, counters = WordHashes(), np.zeros(COUNTERS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("parity", pa.binary()), ("short", pa.list_(pa.int64())), ("block", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        ids, cls, size, odd, short = batch.column(0), [], [], [], []
        for text in (value.as_py() for value in batch.column(1)):
            tokens = shingles(text, hashes)
            slots, n = np.unique(tokens & np.uint64(COUNTERS - 1), return_counts=True)
            counters[slots.astype(np.int64)] += n.astype(np.uint32)
            cls.append(set_class(tokens))
            size.append(len(tokens))
            odd.append(parity(tokens).tobytes())
            short.append(parity(tokens, SHORT_WORDS))
        none = [None] * len(cls)
        columns = (cls, size, odd, short, none, none)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, f.type) for v, f in zip(columns, list(schema)[1:]))], schema=schema)
    if counters.any():
        for i, part in enumerate(np.split(counters, BLOCKS)):
            packed = zlib.compress(part.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, None, None, None, i, packed), schema)], schema=schema)


def _flags(limit: float):
    def add(batches):
        total = np.zeros(COUNTERS // BLOCKS, np.uint64)
        block = None
        for batch in batches:
            for b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = b
                total += np.frombuffer(zlib.decompress(packed), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total > limit).tobytes()], pa.binary())], ["block", "flags"])

    return add


def frequent_flags(profiles: DataFrame) -> np.ndarray:
    """One flag per counter, COUNTERS / 8 bytes in all: the mean load of a counter grows with the input, and so does the limit."""
    load = (profiles.agg(F.sum("n")).first()[0] or 0) / COUNTERS
    limit = load + 6 * math.sqrt(load) + FREQUENT
    flags = np.zeros(COUNTERS, bool)
    counted = profiles.where(F.col("block").isNotNull()).select("block", "counts")
    for r in counted.repartition(BLOCKS, "block").groupBy("block").applyInArrow(_grouped(_flags(limit)), "block int, flags binary").collect():
        size = COUNTERS // BLOCKS
        flags[r["block"] * size : (r["block"] + 1) * size] = np.unpackbits(np.frombuffer(r["flags"], np.uint8)).astype(bool)
    return flags


def _grouped(over_batches):
    """A group's batches one after another."""

    def apply(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(over_batches(table.to_batches()))

    return apply


def bands(n: int) -> set[int]:
    """Size bands under which a document of n tokens forms pairs: a pair of documents uses the band of the smaller one."""
    return {n.bit_length(), max(1, -(-PER_CENT * n // 100)).bit_length()}


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, bool]:
    """Combinations that a document with these tokens indexes, and whether they are rare tokens alone.

    Sets of one or two tokens link with equal sets only, which are one class already.
    """
    n = len(tokens)
    if n <= 2:
        return np.zeros(0, np.uint64), False
    need = n - -(-PER_CENT * n // 100) + 1
    often = frequent[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]
    rare = tokens[~often][:need]
    if len(rare) == need:
        return rare, True
    out, rest = [rare], tokens[often]
    for band in bands(n):
        classes = max(1, (1 << band) // 2 // CLASS_TOKENS)
        own = (mix(rest) % np.uint64(classes)).astype(np.int64)
        first = np.zeros(len(rest), bool)
        first[np.unique(own, return_index=True)[1]] = True
        extended = np.searchsorted(np.cumsum(~first), need - len(rare), side="left") + 1
        prefix, own = rest[:extended], own[:extended]
        order = np.argsort(own, kind="stable")
        for group in np.split(prefix[order], np.flatnonzero(np.diff(own[order])) + 1):
            i, j = np.triu_indices(len(group), 1)
            out.append(mix(mix(group[i] + np.uint64(band)) + group[j] * _BASE))
    return np.concatenate(out), False


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signature_rows(frequent: np.ndarray):
    def rows(batches):
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for text in (value.as_py() for value in batch.column(0)):
                tokens = shingles(text, hashes)
                cls = set_class(tokens)
                if cls in seen:
                    continue
                seen.add(cls)
                found, rare = signatures(tokens, frequent)
                k = len(found)
                if k:
                    n = len(tokens)
                    index = np.arange(k) < n + 1 + -2 * PER_CENT * n // (100 + PER_CENT) if rare else np.ones(k, bool)
                    columns = [_signed(found), pa.array(np.full(k, cls)), pa.array(np.full(k, n, np.int32)), pa.array(index)]
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "cls", "n", "index"])

    return rows


def _gathered(batches):
    """Small batches joined to larger ones."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _bits(batches):
    out, block = np.zeros(1 << 16, bool), None
    for batch in batches:
        block = batch.column(0)[0].as_py()
        out[batch.column(1).to_numpy()] = True
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(out).tobytes()], pa.binary())], ["block", "bits"])


def _needed_filter(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with the hashed ids; more ids than bits only let more documents through. Its 8 MB come
    back in one job, as one job for each partition would take their tasks one after another."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    slots = ids.select(F.shiftright(slot, 16).alias("block"), slot.bitwiseAND(0xFFFF).alias("at")).distinct()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in slots.groupBy("block").applyInArrow(_grouped(_bits), "block int, bits binary").collect():
        bits[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _set_rows(bits):
    def rows(batches):
        hashes = WordHashes()
        for batch in batches:
            slots = batch.column(2).to_numpy()
            let = bits.value[slots >> 3] >> (7 - (slots & 7)) & 1
            for i in np.flatnonzero(let).tolist():
                tokens = shingles(batch.column(1)[i].as_py(), hashes)
                offsets = pa.array([0, len(tokens)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([set_class(tokens)]), pa.ListArray.from_arrays(offsets, _signed(tokens))], ["doc_id", "cls", "tokens"]
                )

    return rows


def _maps(found: pa.Array) -> np.ndarray:
    """Maps of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(found.to_pylist()), np.uint64).reshape(len(found), -1)


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _close_maps(batches):
    """Pairs whose parity maps leave enough to share, without the maps."""
    kept = ["x", "y", "x_rep", "y_rep", "x_n", "y_n"]
    for batch in batches:
        x, y = batch.column("x_parity"), batch.column("y_parity")
        lengths = np.stack([pc.binary_length(x).to_numpy(), pc.binary_length(y).to_numpy()], axis=1)
        differing = np.zeros(batch.num_rows, np.int64)
        for own in np.unique(lengths, axis=0):
            at = np.flatnonzero((lengths == own).all(axis=1))
            words = int(own.min()) // 8
            left, right = (_folded(_maps(maps.take(pa.array(at))), words) for maps in (x, y))
            differing[at] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
        both = batch.column("x_n").to_numpy() + batch.column("y_n").to_numpy()
        enough = (100 + PER_CENT) * (both - differing) >= 2 * PER_CENT * both
        yield batch.select(kept).filter(pa.array(enough))


def _candidates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of classes (x, y) whose parity maps leave enough to share, with their representatives and sizes.

    Sizes of a pair differ by a third at most, so the length of one map is that of the other, or twice it.
    """
    x, y = (reps.select(F.col("cls").alias(c), *[F.col(a).alias(f"{c}_{a}") for a in ("rep", "n", "parity")]) for c in "xy")
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "x_rep", "y_rep", "x_n", "y_n", "x_parity", "y_parity")
    return both.mapInArrow(_close_maps, "x long, y long, x_rep long, y_rep long, x_n long, y_n long")


def _members(groups: DataFrame, of: DataFrame) -> DataFrame:
    """Members of the groups that have one outside the component of their center; ``main`` tells who is in it."""
    members = groups.select("sig", "cls", "n", "index", "center").join(of, "cls").join(of.select(F.col("cls").alias("center"), F.col("comp").alias("center_comp")), "center")
    return members.withColumn("main", F.col("comp") == F.col("center_comp")).drop("center", "center_comp")


def _with_anchors(members: DataFrame, anchors: int) -> DataFrame:
    """Pairs of classes (x < y) in different components: a member outside its group's main component and one of the
    group's ``anchors`` members with the smallest hashes. A member meets them as one short list, and what it meets in
    several groups becomes one pair before pairs are rows; its list is no longer than its signatures times ``anchors``."""
    others = members.where("NOT main")
    first = members.join(others.select("sig").distinct(), "sig", "left_semi")
    first = first.withColumn("at", F.row_number().over(Window.partitionBy("sig").orderBy("cls"))).where(F.col("at") <= anchors)
    met = first.groupBy("sig").agg(F.collect_list(F.struct("cls", "n", "index", "comp")).alias("met"))
    close = f"100 * least(n, m.n) >= {PER_CENT} * greatest(n, m.n)"
    passed = f"filter(met, m -> m.comp != comp AND {close} AND IF(n < m.n OR n = m.n AND cls < m.cls, index, m.index))"
    lists = others.join(met, "sig").select("cls", F.expr(f"transform({passed}, m -> m.cls)").alias("met")).where("size(met) > 0")
    pairs = lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_set("met"))).alias("met")).select("cls", F.explode("met").alias("met"))
    return pairs.select(F.least("cls", "met").alias("x"), F.greatest("cls", "met").alias("y")).distinct()


def _enough(differing: Column) -> Column:
    """Whether the tokens that differ at least leave x and y enough to share."""
    both = F.col("x_n") + F.col("y_n")
    return (100 + PER_CENT) * (both - differing) >= 2 * PER_CENT * both


def _first_meetings(members: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """Pairs of classes (x < y) that share a group and lie in different components, each once or a few times.

    ``maps`` has the short map of every class (cls, short); pairs whose maps leave too little to share are left out. They
    are compared in the join's condition, so that such pairs are no rows.

    Classes that share a passage share many groups. All groups get one order, in which those with the same smallest and
    largest member follow each other, and a member keeps its group before. Two classes make a pair in the first group
    that both are in: there their groups before differ, or one has none. Where those are equal the two have met already.
    Of two members with different components, one is outside the main component, so groups without outsiders are left out.
    """
    group, own = Window.partitionBy("sig"), Window.partitionBy("cls").orderBy("low", "high", "sig")
    placed = members.withColumn("low", F.min("cls").over(group)).withColumn("high", F.max("cls").over(group)).withColumn("whole", F.min("main").over(group))
    placed = placed.where("NOT whole").select("sig", "cls", "n", "comp", "main", F.lag("sig").over(own).alias("before"))
    if maps is not None:  # here, as the rows lie by cls
        placed = placed.join(maps, "cls")
    told = (F.min("before").over(group) != F.max("before").over(group)) | (F.count("before").over(group) < F.count("*").over(group))
    placed = placed.withColumn("told", told).where("told").drop("told")
    x, y = (placed.select("sig", *[F.col(a).alias(f"{c}_{a}") for a in placed.columns if a != "sig"]) for c in "xy")
    once = F.col("y_main") | (F.col("x_cls") < F.col("y_cls"))
    close = 100 * F.least("x_n", "y_n") >= PER_CENT * F.greatest("x_n", "y_n")
    met = F.coalesce(F.col("x_before") == F.col("y_before"), F.lit(False))
    wanted = (F.col("x_comp") != F.col("y_comp")) & close & ~met & once
    if maps is not None:
        bits = (F.bit_count(F.col("x_short")[i].bitwiseXOR(F.col("y_short")[i])) for i in range(SHORT_WORDS))
        wanted &= _enough(functools.reduce(operator.add, bits))
    pairs = x.where("NOT x_main").join(y, "sig").where(wanted)
    return pairs.select(F.least("x_cls", "y_cls").alias("x"), F.greatest("x_cls", "y_cls").alias("y"))


def _sets(needed: DataFrame, rows: DataFrame, unique: bool) -> DataFrame:
    """Sets (doc_id, cls, tokens) of the representatives in ``needed``, and of few others. They are made again for each
    use, as making them costs less than writing them."""
    bits = rows.sparkSession.sparkContext.broadcast(_needed_filter(needed))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int")
    make = _set_rows(bits)
    sets = rows.select("doc_id", "text", slot).mapInArrow(lambda b: _gathered(make(b)), "doc_id long, cls long, tokens array<long>")
    return sets if unique else sets.dropDuplicates(["doc_id", "cls"])


def _verified(pairs: DataFrame, rows: DataFrame, unique: bool) -> DataFrame:
    """Links (a, b: ids of the classes' representatives) among candidate pairs of classes, by the sizes of the intersections.

    ``unique`` says that no id has two rows of one class; else they are reduced to one first.
    """
    left, right = (
        _sets(pairs.select(F.col(f"{c}_rep").alias("doc_id")), rows, unique).select(F.col("doc_id").alias(f"{c}_rep"), F.col("cls").alias(c), F.col("tokens").alias(f"{c}_set"))
        for c in "xy"
    )
    both = pairs.join(left, ["x", "x_rep"]).join(right, ["y", "y_rep"])
    shared = F.size(F.array_intersect("x_set", "y_set"))
    linked = shared * 100 >= PER_CENT * (F.col("x_n") + F.col("y_n") - shared)
    return both.where(linked).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))


def _links(pairs: DataFrame, reps: DataFrame, rows: DataFrame, unique: bool) -> DataFrame | None:
    """Links among pairs of classes, written; None if there are none. The pairs that the maps leave are deleted once they
    are verified."""
    spark = rows.sparkSession
    written = write_table(_candidates(pairs, reps), "pairs")
    left = spark.read.parquet(written)
    links = None if left.isEmpty() else materialize(_verified(left, rows, unique), "verified")
    drop_table(spark, written)
    return None if links is None or links.isEmpty() else links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (smallest id reachable by links, itself included).

    Null texts and texts without words have no set and link with nothing. Rows with equal sets link whatever their ids,
    repeated ids included; null ids have a null component unless other ids share it. Sets and classes are told apart by
    64-bit hashes. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiles = materialize(rows.mapInArrow(_profiles, _PROFILE), "profiles")
    own = profiles.where(F.col("block").isNull()).select("doc_id", "cls", "n", "parity", "short")
    maps = [F.first(c).alias(c) for c in ("parity", "short")]
    reps = materialize(own.where(F.col("n") > 0).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), *maps), "classes")
    make = _signature_rows(frequent_flags(profiles))
    signed = rows.select("text").mapInArrow(lambda b: _gathered(make(b)), "sig long, cls long, n int, index boolean")
    group = Window.partitionBy("sig")
    center = F.min(F.when(F.col("index"), F.struct("n", "cls"))).over(group)
    starred = (
        signed.withColumn("c", center)
        .withColumn("size", F.count("*").over(group))
        .withColumn("others", (F.min("cls").over(group) != F.max("cls").over(group)))
        .where("others AND c IS NOT NULL")  # groups without an index entry give no pairs
        .select("sig", "cls", "n", "index", "size", F.col("c.cls").alias("center"), F.col("c.n").alias("center_n"))
        .dropDuplicates(["sig", "cls"])  # a class comes once from each task; the windows have dealt the rows by sig
    )
    stored = write_table(starred, "groups")
    groups = read_table(spark, stored, starred.schema)
    first = groups.where((F.col("center") != F.col("cls")) & (100 * F.least("center_n", "n") >= PER_CENT * F.greatest("center_n", "n")))
    tried = materialize(first.select(F.least("cls", "center").alias("x"), F.greatest("cls", "center").alias("y")).distinct(), "tried")
    unique = own.where("n > 0").groupBy("doc_id", "cls").count().where("count > 1").isEmpty()
    links = _links(tried, reps, rows, unique)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    joined = components(links)
    for larger, anchors in ((groups, ANCHORS), (groups.where(F.col("size") > ANCHORS), None)):
        of = reps.join(joined, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("comp"))
        written = write_table(_members(larger, of), "members")
        members = spark.read.parquet(written)
        pairs = _with_anchors(members, anchors) if anchors else _first_meetings(members, reps.select("cls", "short")).distinct()
        pairs = materialize(pairs.join(tried, ["x", "y"], "left_anti"), "tried")
        drop_table(spark, written)
        tried = tried.union(pairs)
        more = _links(pairs, reps, rows, unique)
        if more is not None:
            links = links.union(more)
            joined = components(links)
    drop_table(spark, stored)
    reached = reps.join(joined, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    return own.join(reached, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
