"""Prefix trie of conversations by union-find over sorted-neighbour LCP edges.

A conversation is cut into segments of ``segment`` turns, each with a digest of all turns before it. Equal segments after equal
beginnings are one row with a count. The rows are range-sorted, so that rows with a common prefix are neighbours. In each
block of a partition the edges between neighbours are taken by falling length of their common prefix (LCP): a merge of
two components at a depth where neither has a node creates a branching node. What lies between two such nodes is a chain
with the same members. Nodes that hold a block's first or last row may go on in the next block: they are contracted to
one row per depth, merged across boundaries by the digest of their prefix, and what they gain is added to their ancestors.

No task holds more than a block, a segment or a list of ids of bounded length; the driver holds a few numbers.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize

#: Turns of a segment, and bytes of a turn's digest.
SEGMENT, DIGEST = 64, 16
#: Fixed values of the rebuilt conversations: every conversation begins as the first of its BLOCK, for up to LEAD - 1 turns.
BLOCK, LEAD = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, place ``at`` from 0, digest ``key`` of role and text, and ``bytes`` of the text, for every turn.

    Places come from a range sort: a row's number in its partition's run of the conversation plus the lengths of the runs
    before, so that a conversation with a third of all rows is spread over many tasks. Equal turn numbers are ordered by digest.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"), size.alias("bytes")
    )
    order = ("conv_id", "turn", "key")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select("conv_id", "key", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "turns")
    runs = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = runs.withColumn("before", F.sum("n").over(before)).where("before IS NOT NULL").drop("n")
    inside = Window.partitionBy("conv_id", "part").orderBy("row")
    return (
        ranged.withColumn("own", F.row_number().over(inside) - F.lit(1))
        .join(later, ["conv_id", "part"], "left")
        .select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("at"), "key", "bytes")
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and every conversation with its number of rebuilt turns.

    A conversation takes the first h turns of the first of its block (all if fewer), then its own after its first h.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own_turns"))
    head = F.col("conv_id") - F.col("conv_id") % F.lit(BLOCK)
    lead = (F.crc32(F.col("conv_id").cast("string")) % F.lit(LEAD)).alias("lead")
    convs = (
        lengths.select("conv_id", "own_turns", lead, head.alias("head"))
        .join(lengths.toDF("head", "head_turns"), "head", "left")
        .withColumn("led", F.least("lead", F.coalesce("head_turns", F.lit(0))))
        .select("conv_id", "lead", "led", (F.col("led") + F.greatest(F.col("own_turns") - F.col("lead"), F.lit(0))).alias("turns"))
    )
    convs = materialize(convs, "conversations")
    own = turns.join(convs, "conv_id").where(F.col("at") >= F.col("lead")).select("conv_id", (F.col("at") - F.col("lead") + F.col("led")).alias("at"), "key", "bytes")
    steps = F.sequence(F.lit(1 - BLOCK).cast("long"), F.lit(BLOCK - 1).cast("long"))
    led = (
        turns.where((F.col("conv_id") % F.lit(BLOCK) == 0) & (F.col("at") < LEAD - 1))
        .select(F.col("conv_id").alias("head"), "at", "key", "bytes", F.explode(steps).alias("step"))
        .withColumn("conv_id", F.try_add(F.col("head"), F.col("step")))
        .where(F.col("conv_id") - F.col("conv_id") % F.lit(BLOCK) == F.col("head"))
        .join(convs, "conv_id")
        .where(F.col("at") < F.col("led"))
        .select("conv_id", "at", "key", "bytes")
    )
    return own.union(led), convs


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """``conv_id``, ``seg``, its turns' digests ``keys`` and ``sizes``, digests ``p1``, ``p2`` of all segments before it,
    ``n1``, ``n2`` of those up to it, and whether there are ``more``."""
    entry = F.struct("at", "key", "bytes")
    cut = (
        turns.groupBy("conv_id", F.floor(F.col("at") / F.lit(segment)).alias("seg"))
        .agg(F.array_sort(F.collect_list(entry)).alias("own"))
        .select(
            "conv_id",
            "seg",
            F.unhex(F.array_join(F.transform("own", lambda e: F.hex(e["key"])), "")).alias("keys"),
            F.transform("own", lambda e: e["bytes"]).alias("sizes"),
        )
    )
    cut = materialize(cut, "segments")
    # Only conversations of a whole segment or more can have two: all others need no look at their neighbours.
    full = cut.where((F.col("seg") > 0) | (F.octet_length("keys") == segment * DIGEST))
    order = Window.partitionBy("conv_id").orderBy("seg")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    full = full.select("conv_id", "seg", F.xxhash64("seg", "keys").alias("a"), F.xxhash64(F.lit("second"), "keys", "seg").alias("b"))
    full = full.select(
        "conv_id", "seg",
        F.bit_xor("a").over(before).alias("p1"), F.bit_xor("b").over(before).alias("p2"),
        F.bit_xor("a").over(upto).alias("n1"), F.bit_xor("b").over(upto).alias("n2"),
        F.lead("seg").over(order).isNotNull().alias("more"),
    )
    zero = F.lit(0).cast("long")
    return cut.join(full, ["conv_id", "seg"], "left").withColumns(
        {"p1": F.coalesce("p1", zero), "p2": F.coalesce("p2", zero), "more": F.coalesce("more", F.lit(False))}
    )


GROUP = ("seg", "p1", "p2")
NODES = (
    "open boolean, key binary, up array<binary>, conv_id long, depth long, parent long, parent_key binary, n long, children long, "
    "leaves long, saved long, last long, n_end long, end_conv long, end_key string, seg long, p1 long, p2 long"
)


def common(a: bytes, b: bytes) -> int:
    """Turns that two rows of digests have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * DIGEST] == b[: middle * DIGEST] else (low, middle - 1)
    return low


def contracted(lengths: list[int], lcps: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Depth, parent (-1: none), first and last row of every node of a block.

    Node i < rows is the end of row i; the others are branching nodes. ``lcps[i]`` belongs to the edge of rows i - 1 and i;
    those of 0 or less join nothing. Of equal rows only one may be there; a prefix of a row stands before it.
    """
    rows = len(lengths)
    depth, parent = list(lengths), [-1] * rows
    first, last, top, root = list(range(rows)), list(range(rows)), list(range(rows)), list(range(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # By falling LCP, from left to right among equals: the right component is then never at the edge's depth.
    for edge in np.argsort(-np.asarray(lcps), kind="stable").tolist():
        if lcps[edge] <= 0:
            break
        left, right = find(edge - 1), find(edge)
        a, b = top[left], top[right]
        if depth[a] != lcps[edge]:
            depth.append(lcps[edge])
            parent.append(-1)
            first.append(first[a])
            last.append(last[b])
            parent[a] = top[left] = len(depth) - 1
        parent[b] = top[left]
        last[top[left]] = last[b]
        root[right] = left
    return depth, parent, first, last


def prefix_key(group: tuple, keys: bytes, depth: int) -> bytes:
    return hashlib.md5(repr(group).encode() + keys[: depth * DIGEST]).digest()


def block_nodes(rows: list[dict], segment: int) -> Iterator[tuple]:
    """Every node of a block of sorted rows, as tuples of NODES; open ones with what their closed children give them."""
    groups = [tuple(r[c] for c in GROUP) for r in rows]
    keys = [r["keys"] for r in rows]
    lcps = [-1] + [common(keys[i - 1], keys[i]) if groups[i - 1] == groups[i] else -1 for i in range(1, len(rows))]
    depth, parent, first, last = contracted([len(k) // DIGEST for k in keys], lcps)
    total = len(depth)
    is_open = [first[v] == 0 or last[v] == len(rows) - 1 for v in range(total)]
    n, children, leaves, saved = [0] * total, [0] * total, [0] * total, [0] * total
    low: list = [None] * total
    for v in range(len(rows)):
        r = rows[v]
        n[v], children[v], leaves[v], saved[v], low[v] = r["n"], r["x_children"], r["x_leaves"], r["x_saved"], r["low"]
    by_depth = sorted(range(total), key=depth.__getitem__, reverse=True)
    tops: dict[int, tuple[int, int]] = {}  # leaves and saved of a node's chain
    for v in by_depth:
        sizes, up = rows[first[v]]["sizes"], parent[v]
        above = depth[up] if up >= 0 else 0
        own_leaves = leaves[v] + (0 if children[v] or is_open[v] else 1)
        tops[v] = own_leaves, saved[v] + (n[v] - 1) * sum(sizes[above : depth[v]])
        if up >= 0:
            n[up] += n[v]
            low[up] = low[v] if low[up] is None else min(low[up], low[v])
            if not is_open[v]:
                children[up] += 1
                leaves[up] += tops[v][0]
                saved[up] += tops[v][1]
    for v in range(total):
        r, up, group = rows[first[v]], parent[v], groups[first[v]]
        above, base = (depth[up] if up >= 0 else 0), group[0] * segment
        ends = (rows[v]["n_end"], rows[v]["end_conv"], rows[v]["end_key"]) if v < len(rows) else (0, None, None)
        keyed = [prefix_key(group, r["keys"], k) for k in range(depth[v], 0, -1)] if is_open[v] else []
        rest = saved[v]
        for k in range(depth[v], above, -1):
            at_end = k == depth[v]
            size = r["sizes"][k - 1]
            own_ends = ends if at_end else (0, None, None)
            top = r["top"] if k == 1 else None
            if is_open[v]:
                own = (children[v], leaves[v], saved[v]) if at_end else (0, 0, 0)
                skip = depth[v] - k
                yield (True, keyed[skip], keyed[skip + 1 :], low[v], base + k, top, None, n[v], *own, size, *own_ends, *group)
                continue
            rest += (n[v] - 1) * size
            key, from_low = None, top
            if k > 1:
                if k - 1 > above:
                    from_low = low[v]
                elif is_open[up]:
                    key, from_low = prefix_key(group, r["keys"], above), None
                else:
                    from_low = low[up]
            yield (False, None, None, low[v], base + k, from_low, key, n[v], children[v] if at_end else 1, tops[v][0], rest, size, *own_ends, *group)


def forest(unique: DataFrame, segment: int) -> DataFrame:
    """All nodes of the given segment rows, as NODES without the open ones' unfinished sums."""
    order = (*GROUP, "keys")
    names = [f.split()[0] for f in NODES.split(", ")]
    ranged = unique.repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.bool_(), pa.binary(), pa.list_(pa.binary()), *[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 7, pa.string(), *[pa.int64()] * 3]
        for batch in batches:
            if batch.num_rows:
                columns = list(zip(*block_nodes(batch.to_pylist(), segment)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    found = materialize(ranged.mapInArrow(blocks, NODES), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved", "n_end")]
    same = [F.first(c, ignorenulls=True).alias(c) for c in ("up", "depth", "parent", "last", "end_conv", "end_key", *GROUP)]
    merged = materialize(found.where("open").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *same), "open-nodes")
    above = F.get("up", F.lit(0))
    gained = merged.where(F.size("up") > 0).groupBy(above.alias("key")).agg(F.count("*").alias("gained"))
    merged = merged.join(gained, "key", "left").withColumn("children", F.col("children") + F.coalesce("gained", F.lit(0))).drop("gained")
    leaf = F.when(F.col("children") == 0, 1).otherwise(0)
    given = (
        merged.select(
            F.explode(F.concat(F.array("key"), "up")).alias("key"),
            (F.col("leaves") + leaf).alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.col("last")).alias("saved"),
        )
        .groupBy("key")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    lows = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_low"))
    opened = merged.drop("leaves", "saved").join(given, "key").withColumn("parent_key", above)
    opened = opened.join(lows, "parent_key", "left").withColumn("parent", F.coalesce("parent_low", "parent"))
    columns = ("conv_id", "depth", "parent", "n", "children", "leaves", "saved", "n_end", "end_conv", "end_key", *GROUP)
    closed = found.where(~F.col("open"))
    hung = closed.where(F.col("parent_key").isNotNull()).join(lows, "parent_key", "left").withColumn("parent", F.col("parent_low"))
    return closed.where(F.col("parent_key").isNull()).select(*columns).union(hung.select(*columns)).union(opened.select(*columns))


def with_deeper(unique: DataFrame, cut: DataFrame, segment: int) -> DataFrame:
    """``unique`` with what its rows gain from the segments behind them, and the smallest member of the node before them.

    A first pass over the later segments alone gives each group's own sums. A group's sums go to all groups before it
    along one of its conversations: a running sum per conversation, then a sum per group, whatever the number of segments.
    """
    zero = F.lit(0).cast("long")
    more = F.when(F.col("n_end") < F.col("n"), 1).otherwise(0)
    later = unique.where("seg > 0").withColumns({"x_children": more.cast("long"), "x_leaves": zero, "x_saved": zero, "top": F.lit(None).cast("long")})
    own = forest(later, segment).where(F.col("depth") == F.col("seg") * segment + 1).groupBy(*GROUP)
    own = own.agg(F.count("*").alias("x_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("conv_id").alias("conv_id"))
    own = materialize(own, "groups")
    behind = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, 0)
    chained = cut.where("seg > 0").select("conv_id", *GROUP).join(own.drop("x_children"), ["conv_id", *GROUP], "left")
    chained = chained.select(*GROUP, *[F.sum(F.coalesce(c, zero)).over(behind).alias(c) for c in ("leaves", "saved")])
    given = chained.groupBy(*GROUP).agg(F.sum("leaves").alias("x_leaves"), F.sum("saved").alias("x_saved")).join(own.select(*GROUP, "x_children"), [*GROUP])
    given = given.select((F.col("seg") - 1).alias("seg"), F.col("p1").alias("n1"), F.col("p2").alias("n2"), "x_children", "x_leaves", "x_saved")
    tops = unique.where("n_end < n").select((F.col("seg") + 1).alias("seg"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("low").alias("top"))
    # Rows that neither follow a segment nor have one behind them meet no other table.
    alone = unique.where("seg = 0 AND n_end = n").withColumns({"x_children": zero, "x_leaves": zero, "x_saved": zero, "top": F.lit(None).cast("long")})
    long = unique.where("seg > 0 OR n_end < n").join(given, ["seg", "n1", "n2"], "left").join(tops, [*GROUP], "left")
    long = long.withColumns({c: F.coalesce(c, zero) for c in ("x_children", "x_leaves", "x_saved")})
    return alone.unionByName(long)


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of every ``end_key``'s ids, ascending and joined by commas.

    Range-sorted ids become texts of at most a batch each in many tasks; one task then hashes a key's texts one after another.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            runs = list(zip(starts, [*starts[1:], len(keys)]))
            yield pa.RecordBatch.from_pydict(
                {"end_key": [keys[a] for a, _ in runs], "first": [ids[a] for a, _ in runs], "ids": [",".join(map(str, ids[a:b])) for a, b in runs]}
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hasher = None, None
        for batch in batches:
            done = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != key:
                    if hasher:
                        done.append((key, hasher.hexdigest()))
                    key, hasher = own, hashlib.sha256(ids.encode())
                else:
                    hasher.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"end_key": [k for k, _ in done], "ends": [d for _, d in done]})
        if hasher:
            yield pa.RecordBatch.from_pydict({"end_key": [key], "ends": [hasher.hexdigest()]})

    ranged = ends.select("end_key", "conv_id").repartitionByRange("end_key", "conv_id").sortWithinPartitions("end_key", "conv_id")
    joined = ranged.mapInArrow(texts, "end_key string, first long, ids string")
    return joined.repartition(F.col("end_key")).sortWithinPartitions("end_key", "first").mapInArrow(digests, "end_key string, ends string")


def end_key() -> Column:
    return F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in GROUP], F.hex("keys")))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per distinct beginning of a rebuilt conversation, from the root of depth 0.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Null roles and texts are empty, turns without a number come first and equal numbers in the
    order of their digests; repeated rows are turns like others. Rows without a conv_id belong to no conversation and are
    left out; no conversations give no rows, not even a root. Turns are told apart by 128-bit digests. Other columns are not read.
    """
    turns = materialize(placed_turns(conversations), "placed")
    again, convs = rebuilt(turns)
    cut = materialize(segments(again, segment), "segments")
    unique = cut.groupBy(*GROUP, "keys").agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.sum((~F.col("more")).cast("long")).alias("n_end"),
        F.min(F.when(~F.col("more"), F.col("conv_id"))).alias("end_conv"), F.first("n1").alias("n1"), F.first("n2").alias("n2"),
    )
    unique = materialize(unique.withColumn("end_key", F.when(F.col("n_end") > 1, end_key())), "unique")
    if cut.where("more").isEmpty():
        zero = F.lit(0).cast("long")
        unique = unique.withColumns({"x_children": zero, "x_leaves": zero, "x_saved": zero, "top": F.lit(None).cast("long")})
    else:
        unique = with_deeper(unique, cut, segment)
    nodes = materialize(forest(unique, segment), "trie")

    root_key = F.lit("root")
    firsts = nodes.where("depth = 1").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    turnless = F.when(F.col("turns") == 0, F.col("conv_id"))
    all_of = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.count(turnless).alias("n_end"), F.min(turnless).alias("end_conv")).first()
    if not all_of["n"]:
        return conversations.sparkSession.createDataFrame([], RESULT)
    lowest = F.lit(all_of["conv_id"]).cast("long")
    root = firsts.select(
        lowest.alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent"),
        F.lit(all_of["n"]).cast("long").alias("n"),
        "children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved"),
        F.lit(all_of["n_end"]).cast("long").alias("n_end"),
        F.lit(all_of["end_conv"]).cast("long").alias("end_conv"),
        root_key.alias("end_key"),
    )
    columns = root.columns
    every = nodes.withColumn("parent", F.when(F.col("depth") == 1, lowest).otherwise(F.col("parent"))).select(*columns).union(root)

    shared = nodes.where("n_end > 1").select("end_key")
    ends = cut.where(~F.col("more")).select(end_key().alias("end_key"), "conv_id").join(shared, "end_key", "left_semi")
    ends = ends.union(convs.where("turns = 0").select(root_key.alias("end_key"), "conv_id"))
    hashed = every.where("n_end > 1").join(id_digests(ends), "end_key", "left")
    alone = every.where("n_end <= 1").withColumn(
        "ends", F.when(F.col("n_end") == 1, F.sha2(F.col("end_conv").cast("string"), 256)).otherwise(F.lit(EMPTY))
    )
    names = ("conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ends")
    return alone.select(*names).union(hashed.select(*names)).toDF(*[f.split()[0] for f in RESULT.split(", ")])


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

#: The rows of prefix_trie() over conversations with distinct turn numbers. The lead is the CRC-32 of the id, bit by bit.
ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
    md5(strlen(role) || ':' || role || text) AS k, strlen(text) AS bytes FROM t),
n AS (SELECT conv_id, count(*) AS own, conv_id::VARCHAR AS id FROM p GROUP BY conv_id),
c AS (SELECT conv_id, own, conv_id - conv_id % 5 AS head, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda a, z: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS lead FROM n),
l AS (SELECT c.conv_id, c.head, c.lead, least(c.lead, coalesce(n.own, 0)) AS led FROM c LEFT JOIN n ON n.conv_id = c.head),
r AS (SELECT l.conv_id, p.pos, p.k, p.bytes FROM l JOIN p ON p.conv_id = l.head WHERE p.pos < l.led
    UNION ALL SELECT l.conv_id, p.pos - l.lead + l.led, p.k, p.bytes FROM l JOIN p ON p.conv_id = l.conv_id WHERE p.pos >= l.lead),
s AS (SELECT l.conv_id, coalesce(list(r.k ORDER BY pos) FILTER (r.k IS NOT NULL), []) AS ks,
    coalesce(list(r.bytes ORDER BY pos) FILTER (r.k IS NOT NULL), []) AS bs FROM l LEFT JOIN r ON r.conv_id = l.conv_id GROUP BY l.conv_id),
m AS (SELECT conv_id, unnest(range(0, len(ks) + 1)) AS d, ks, bs FROM s),
v AS (SELECT d, list_slice(ks, 1, d) AS pre, min(conv_id) AS low, count(*) AS n, coalesce(max(list_extract(bs, d::INT)), 0) AS bytes,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ks) = d) AS ends FROM m GROUP BY 1, 2),
k AS (SELECT d - 1 AS d, list_slice(pre, 1, d - 1) AS pre, count(*) AS children FROM v WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT v.*, coalesce(k.children, 0) AS children, coalesce(k.children, 0) = 0 AS leaf FROM v LEFT JOIN k ON k.d = v.d AND k.pre = v.pre),
x AS (SELECT unnest(range(0, d + 1)) AS d, pre, n, bytes, leaf FROM w),
y AS (SELECT d, list_slice(pre, 1, d) AS pre, sum(leaf::INT)::BIGINT AS leaves, sum((n - 1) * bytes)::BIGINT AS saved FROM x GROUP BY 1, 2)
SELECT w.low AS conv_id, w.d::BIGINT AS depth, u.low AS parent_conv_id, w.n AS n_convs, w.children AS n_children, y.leaves AS n_leaves,
  y.saved AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN y ON y.d = w.d AND y.pre = w.pre LEFT JOIN v u ON u.d = w.d - 1 AND u.pre = list_slice(w.pre, 1, w.d - 1)
"""
