"""The prefix trie against dictionaries of all beginnings."""

import collections
import hashlib
import random
import zlib

import pytest

from shelfcast.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, keys string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h, head = zlib.crc32(str(c).encode()) % 9, c - c % 5 if c >= 0 else c + (-c) % 5
        convs[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        gain = (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += gain
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], digest))
    return out


def run(spark, rows, parts=5, **options):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(parts)
    return [tuple(r) for r in trie.prefix_trie(frame, **options).collect()]


def same(got, expected):
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.fixture
def conversations():
    """Shared beginnings, copies that are a third of all, nulls, ties, repeated rows, and ends inside others."""
    rng = random.Random(11)
    rows = []
    for c in rng.sample(range(-40, 400), 150):
        if rng.random() < 0.35:
            rows += [(c, t, "user", f"hot {t}") for t in range(4)]
            continue
        for t in range(rng.randint(1, 14)):
            turn = rng.choice((t, t, t, t, None, 3))
            rows.append((c, turn, rng.choice(("user", "bot", None)), rng.choice(("a", "b", "é😀", "", None))))
    return rows + rows[:5] + [(None, 0, "user", "nobody"), (None, None, None, None)]


def test_matches_all_beginnings(spark, conversations):
    same(run(spark, conversations), brute(conversations))


@pytest.mark.parametrize("batch", ["1", "7"])
def test_blocks_merge_across_boundaries(spark, conversations, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        same(run(spark, conversations), brute(conversations))
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("segment", [1, 2, 64])
def test_long_conversations(spark, conversations, segment):
    """More turns than a segment has: shared past one or more of its ends, stopping at them, and going on alone."""
    long = [("user" if t % 2 else "bot", f"turn {t % 50}") for t in range(300)]
    cuts = {0: 300, 1: 64, 2: 65, 3: 128, 4: 129, 5: 63, 10: 300, 15: 192}
    rows = [(c, t, *long[t]) for c, n in cuts.items() for t in range(n)]
    rows += [(c, t, *(long[t] if t < 130 + c else ("bot", f"own {c} {t % 3}"))) for c in (20, 21, 25, 30) for t in range(200)]
    rows = [r for r in rows if segment == 64 or r[1] < 20] + conversations
    same(run(spark, rows, segment=segment), brute(rows))


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(7, 0, "a", "b")], [(5, None, None, None), (5, None, None, None)], [(c, 0, "a", "x") for c in range(30)]):
        same(run(spark, rows), brute(rows))


def test_contracted_nodes_of_a_block():
    """Rows ab, abc, abd, b: node ab branches, and is the end of the first row."""
    depth, parent, first, last = trie.contracted([2, 3, 3, 1], [-1, 2, 2, 0])
    assert (depth, parent) == ([2, 3, 3, 1], [-1, 0, 0, -1]) and (first[0], last[0]) == (0, 2)
