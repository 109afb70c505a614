"""SentencePiece encoding and decoding by max-plus algebra over a lattice of pieces.

The encoding of a text is the segmentation with the largest sum of the vocabulary's scores. Giant documents are
split into chunks. What a chunk needs to know of its neighbours is how many of its first characters a piece of
the chunk before has taken: that is its boundary state. The best score for each (state at its start, state at its
end) is the chunk's transfer matrix; matrices combine associatively under (max, +), so a scan over them gives the best
state at every boundary, and then each chunk is backtraced on its own. A document of one chunk has state 0 at both ends.

A space is written as U+2581 and one is put before the text. A character without a piece costs
``UNKNOWN`` less than the lowest score and is encoded as its UTF-8 bytes, as is a literal U+2581, so decoding is exact.
Ties: the longest last piece wins, at boundaries the smallest state.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialize

#: Code points of a chunk; a document with more has several.
CHUNK = 32_768
UNKNOWN = 10.0
#: Segments that a task remembers at most (some 100 MB), those that a worker keeps between tasks, and characters of the longest.
CACHE_SEGMENTS, KEPT_SEGMENTS, CACHED_LENGTH = 400_000, 50_000, 64
#: Code points that are encoded side by side.
PASS_CHARS = 400_000
SPACE = "▁"
NONE = -np.inf


_MADE: dict[str, dict] = {}


@dataclass
class Vocabulary:
    key: str
    ids: dict[str, int]
    scores: list[float]
    pieces: list[str]
    bytes_: list[int]
    longest: int
    unknown: float
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        whole = "".join(self.ids)
        # If no piece has a space after another character, no piece crosses there; nor a control character without a piece.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = re.escape("".join(c for c in map(chr, range(32)) if c not in whole)) or "\x00"
        self.shown = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in self.pieces]
        for b, i in enumerate(self.bytes_):
            self.shown[i] = bytes([b])
        # Tree of the pieces: per character the piece that ends there (-1: none) and the characters that may follow.
        self.tree: dict = {}
        for p, i in self.ids.items():
            at = self.tree
            for c in p[:-1]:
                at = at.setdefault(c, [-1, {}])[1]
            at.setdefault(p[-1], [-1, {}])[0] = i
        self.segments = re.compile(rf"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("key", "ids", "scores", "pieces", "bytes_", "longest", "unknown")} | {"cache": {}}

    def __setstate__(self, state):
        """A worker makes the search tables once and keeps them, with the cache, for its later tasks."""
        made = _MADE.get(state["key"])
        if made is None:
            self.__dict__.update(state)
            self.__post_init__()
            made = _MADE[state["key"]] = self.__dict__
        self.__dict__ = made

    def split(self, text: str) -> list[str]:
        """Segments that no piece crosses; the whole text if the vocabulary has pieces that could cross anywhere."""
        return self.segments.findall(text) if self.cuts else [text] if text else []


def load(path: str) -> Vocabulary:
    """The pieces of a model file, read once by the driver: their number is fixed by the file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces = [p.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    found = {int(pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
    if len(found) != 256:
        raise ValueError("the vocabulary needs a piece for each byte")
    scores = [p.get_score(i) for i in range(n)]
    low = min(scores[i] for i in normal)
    key = hashlib.sha256(repr((pieces, scores)).encode("utf-8", "surrogatepass")).hexdigest()
    return Vocabulary(key, {pieces[i]: i for i in normal}, scores, pieces, [found[b] for b in range(256)], max(len(pieces[i]) for i in normal), low - UNKNOWN)


def forward(v: Vocabulary, text: str, start: int, stop: int) -> tuple[list[float], list[int]]:
    """Best score and last piece's beginning for each place, of paths from ``start`` whose pieces begin before ``stop``.

    Places up to ``len(text)`` may be reached; a place is open if a piece can begin there."""
    n, tree, scores, unknown = len(text), v.tree, v.scores, v.unknown
    best, begin = [NONE] * (n + 1), [-1] * (n + 1)
    best[start] = 0.0
    for i in range(start, min(stop, n)):
        here = best[i]
        if here == NONE:
            continue
        first = tree.get(text[i])
        if (first is None or first[0] < 0) and here + unknown > best[i + 1]:
            best[i + 1], begin[i + 1] = here + unknown, i
        if first is None:
            continue
        piece, following = first
        j = i + 1
        while True:
            if piece >= 0 and here + scores[piece] > best[j]:
                best[j], begin[j] = here + scores[piece], i
            if j == n:
                break
            step = following.get(text[j])
            if step is None:
                break
            piece, following = step
            j += 1
    return best, begin


def _path(v: Vocabulary, text: str, begin: list[int], start: int, end: int) -> list[int]:
    out, at = [], end
    while at > start:
        i = begin[at]
        piece = v.ids.get(text[i:at])
        if piece is not None:
            out.append(piece)
        else:
            out.extend(v.bytes_[b] for b in reversed(text[i:at].encode("utf-8", "surrogatepass")))
        at = i
    out.reverse()
    return out


def _segment(v: Vocabulary, s: str) -> tuple[float, list[int]]:
    got = v.cache.get(s)
    if got is None:
        best, begin = forward(v, s, 0, len(s))
        got = best[-1], _path(v, s, begin, 0, len(s))
        if len(s) <= CACHED_LENGTH:
            if len(v.cache) > KEPT_SEGMENTS:
                v.cache.clear()
            v.cache[s] = got
    return got


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode(v: Vocabulary, written: str) -> tuple[float, list[int]]:
    """Score and ids of a normalised text without literal U+2581, boundary states 0."""
    score, ids, known = 0.0, [], v.cache.get
    for s in v.split(written):
        a, b = known(s) or _segment(v, s)
        score += a
        ids += b
    return score, ids


def encode_text(v: Vocabulary, text: str) -> tuple[float, list[int]]:
    if SPACE not in text:
        return encode(v, normalised(text))
    score, ids = 0.0, []
    for i, part in enumerate(text.split(SPACE)):
        if i:
            score += v.unknown
            ids += [v.bytes_[b] for b in SPACE.encode()]
        a, b = encode(v, (SPACE if i == 0 else "") + part.replace(" ", SPACE))
        score, ids = score + a, ids + b
    return score, ids


def decode(v: Vocabulary, ids) -> str:
    return b"".join(map(v.shown.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _cut(v: Vocabulary, body: str) -> tuple[int, int, list[str]] | None:
    """First and last place in a chunk, and after its beginning, that no piece crosses, and the segments between them."""
    found = v.split(body) if v.cuts else []
    return (len(found[0]), len(body) - len(found[-1]), found[1:-1]) if len(found) > 1 else None


def _in_passes(v: Vocabulary, bodies: list[str], segments: "Segments", of) -> list:
    """``of`` (a chunk's number, its cut) for every chunk; the segments of a pass's chunks are numbered together before."""
    out, held, total = [], [], 0
    for n, body in enumerate(bodies):
        held.append((n, _cut(v, body)))
        total += len(body)
        if total >= PASS_CHARS or n == len(bodies) - 1:
            segments.numbers([s for _, cut in held if cut for s in cut[2]])
            out += [of(n, cut) for n, cut in held]
            segments.trim()
            held, total = [], 0
    return out


def transfer(v: Vocabulary, body: str, ahead: str, last: bool, segments: "Segments | None" = None, cut=()) -> np.ndarray:
    """Matrix of best scores from each state at the chunk's start to each state at its end.

    ``ahead`` is the beginning of the next chunk, as far as a piece can reach. With a place in the chunk that no
    piece crosses, the matrix is the sum of a column (before it) and a row (after it)."""
    k, n = v.longest, len(body)
    text = body + ahead
    states = 1 if last else k

    def ends(best):
        return np.array([best[n + t] if n + t <= len(text) else NONE for t in range(states)] + [NONE] * (k - states))

    cut = _cut(v, body) if cut == () else cut
    if cut is None:
        return np.array([ends(forward(v, text, s, n)[0]) if s <= n else [NONE] * k for s in range(k)])
    a, b, between = cut
    head = np.array([forward(v, body[:a], s, a)[0][a] if s <= a else NONE for s in range(k)])
    middle, _ = (segments or Segments(v)).joined(between)
    tail = forward(v, text[b:], 0, n - b)[0]
    row = np.array([tail[n - b + t] if n + t <= len(text) else NONE for t in range(states)] + [NONE] * (k - states))
    return head[:, None] + middle + row[None, :]


def backtrace(v: Vocabulary, body: str, ahead: str, enter: int, leave: int, segments: "Segments | None" = None, cut=()) -> list[int]:
    """Ids of the pieces that begin in the chunk, given its boundary states."""
    n = len(body)
    text = body + ahead[:leave]
    cut = _cut(v, body) if cut == () else cut
    if cut is None or enter > cut[0]:
        _, begin = forward(v, text, enter, n)
        return _path(v, text, begin, enter, n + leave)
    a, b, between = cut
    out = _path(v, body[:a], forward(v, body[:a], enter, a)[1], enter, a)
    out += (segments or Segments(v)).joined(between)[1].tolist()
    return out + _path(v, text[b:], forward(v, text[b:], 0, n - b)[1], 0, n + leave - b)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of (stacks of) transfer matrices; associative."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def boundary_states(matrices: np.ndarray) -> tuple[np.ndarray, float]:
    """State at every boundary (0 at both ends) and the total: an inclusive scan in log2(n) combined steps, then back along it."""
    scan, step = matrices.copy(), 1
    while step < len(scan):
        scan = np.concatenate([scan[:step], combine(scan[:-step], scan[step:])])
        step *= 2
    states = np.zeros(len(matrices) + 1, np.int64)
    for i in range(len(matrices) - 1, 0, -1):
        states[i] = int(np.argmax(scan[i - 1][0] + matrices[i][:, states[i + 1]]))
    return states, float(scan[-1][0, 0])


_ENCODED = "doc_id long, n_chars long, n_chunks int, n_tokens long, score double, token_ids array<int>, round_trip boolean"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_chunks", pa.int32()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]
)


class Lattices:
    """Best segmentations of many short segments at once, whatever their lengths.

    Segments lie side by side, the longest first, so that a step over the places of all is one operation on those that
    are long enough. Pieces are found by the polynomial hash of every substring, from prefix hashes: the first bits lead
    to the pieces that share them. The bytes of the found pieces are compared with the segment in the end. Scores and ties are
    those of ``forward``.
    """

    BASE, BITS = np.uint64(0x9E3779B97F4A7C15), 20
    #: Segments side by side.
    MOST = 4_096

    def __init__(self, v: Vocabulary):
        self.v = v
        ids = np.fromiter(v.ids.values(), np.int64, len(v.ids))
        keys = np.zeros(len(ids), np.uint64)
        by_length: dict[int, list[int]] = {}
        names = list(v.ids)
        for k, p in enumerate(names):
            by_length.setdefault(len(p), []).append(k)
        for n, own in by_length.items():
            keys[own] = self.hashes(self.codes([names[k] for k in own], n))[n] * self.BASE  # spreads short pieces over the first bits
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], ids[order]
        at = (keys[order] >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.full(1 << self.BITS, -1, np.int32)
        first, many = np.unique(at, return_index=True, return_counts=True)[1:]
        self.first[at[first]] = first
        self.depth = int(many.max(initial=1))
        self.scores = np.array(v.scores)
        self.powers = [np.uint64(pow(int(self.BASE), k, 2**64)) for k in range(v.longest + 1)]

    @staticmethod
    def codes(texts: list[str], n: int) -> np.ndarray:
        """Characters by place and text, counted from 1, so that none is like nothing; 0 beyond a text's end."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros((n, len(texts)), np.uint64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[place, np.repeat(np.arange(len(texts)), sizes)] = flat.astype(np.uint64) + np.uint64(1)
        return out

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hash of every prefix, by place and text."""
        out = np.zeros((len(codes) + 1, codes.shape[1]), np.uint64)
        for k in range(len(codes)):
            out[k + 1] = out[k] * self.BASE + codes[k]
        return out

    def segmented(self, segments: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """Groups of the segments: their scores, all ids, the number of ids of each, and the bytes that they decode to."""
        short = sorted((s for s in segments if 0 < len(s) <= CACHED_LENGTH), key=len, reverse=True)
        for at in range(0, len(short), self.MOST):
            yield self._group(short[at : at + self.MOST])
        for s in segments:
            if not 0 < len(s) <= CACHED_LENGTH:
                yield self._alone(s)

    def _shown(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.shown.__getitem__, ids))

    def _alone(self, s: str):
        best, begin = forward(self.v, s, 0, len(s))
        ids = _path(self.v, s, begin, 0, len(s))
        return [s], np.array([best[-1]]), np.array(ids, np.int32), np.array([len(ids)]), [self._shown(ids)]

    def _group(self, own: list[str]):
        """Of segments that come by falling length."""
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        longest = int(sizes[0])
        prefix = self.hashes(self.codes(own, longest))
        best = np.full((longest + 1, len(own)), NONE)
        best[0] = 0.0
        begin, piece = np.zeros((longest + 1, len(own)), np.int32), np.full((longest + 1, len(own)), -1, np.int32)
        many = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")  # segments that reach a place
        for j in range(1, longest + 1):
            n = int(many[j])
            for i in range(max(0, j - self.v.longest), j):
                key = (prefix[j, :n] - prefix[i, :n] * self.powers[j - i]) * self.BASE
                rows, found = self._found(key)
                if j - i == 1 and len(rows) < n:
                    alone = np.ones(n, bool)
                    alone[rows] = False
                    self._take(best, begin, piece, np.flatnonzero(alone), i, j, self.v.unknown, -1)
                if len(rows):
                    self._take(best, begin, piece, rows, i, j, self.scores[found], found)
        return self._traced(own, sizes, best, begin, piece)

    def _found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that pieces have, and the pieces."""
        first = self.first[(key >> np.uint64(64 - self.BITS)).astype(np.int64)]
        rows = np.flatnonzero(first >= 0)
        at, key = first[rows], key[rows]
        true = self.keys[at] == key
        left = np.flatnonzero(~true)
        for _ in range(1, self.depth):  # pieces whose keys share their first bits
            left = left[self.keys[at[left]] < key[left]]
            at[left] = np.minimum(at[left] + 1, len(self.ids) - 1)
            true[left] = self.keys[at[left]] == key[left]
        return rows[true], self.ids[at[true]]

    @staticmethod
    def _take(best, begin, piece, rows, i, j, score, found) -> None:
        value = best[i, rows] + score
        better = value > best[j, rows]
        kept = rows[better]
        best[j, kept], begin[j, kept] = value[better], i
        piece[j, kept] = found if np.isscalar(found) else found[better]

    def _traced(self, own: list[str], sizes: np.ndarray, best, begin, piece):
        rows, at, taken, strange = np.arange(len(own)), sizes.copy(), [], np.zeros(len(own), bool)
        steps = np.zeros(len(own), np.int64)
        while len(rows):
            p = piece[at, rows]
            strange[rows[p < 0]] = True
            taken.append((rows, p))
            steps[rows] += 1
            at = begin[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        ends = np.cumsum(steps)
        ids = np.zeros(int(steps.sum()), np.int32)
        for k, (rows, p) in enumerate(taken):
            ids[ends[rows] - 1 - k] = p
        scores = best[sizes, np.arange(len(own))]
        flat, shown, again = ids.tolist(), [], {}
        for k, (s, end, n) in enumerate(zip(own, ends.tolist(), steps.tolist())):
            one = None if strange[k] else self._shown(flat[end - n : end])
            # Characters without a piece, or two texts with one hash.
            if one is None or one != s.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                again[k] = self._alone(s)
                one = again[k][4][0]
            shown.append(one)
        if again:
            parts = np.split(ids, ends[:-1])
            for k, (_, score, other, n, _) in again.items():
                parts[k], scores[k], steps[k] = other, score[0], n[0]
            ids = np.concatenate(parts)
        return own, scores, ids, steps, shown


class Segments:
    """Numbers for segments, and for each its score, its ids (one after another in ``flat``) and the bytes that they decode to."""

    def __init__(self, v: Vocabulary):
        self.v, self.lattices = v, Lattices(v)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.scores, self.starts = np.zeros(1024), np.zeros(1025, np.int64)
        self.flat = np.zeros(4096, np.int32)

    def add(self, segments: list[str], scores: np.ndarray, ids: np.ndarray, many: np.ndarray, shown: list[bytes]) -> None:
        i, n = len(self.shown), len(segments)
        at = int(self.starts[i])
        if i + n >= len(self.scores):
            more = max(i + n + 1, len(self.scores) * 3 // 2) - len(self.scores)
            self.scores, self.starts = np.append(self.scores, np.zeros(more)), np.append(self.starts, np.zeros(more, np.int64))
        if at + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(max(at + len(ids), len(self.flat) * 3 // 2) - len(self.flat), np.int32))
        self.flat[at : at + len(ids)] = ids
        self.scores[i : i + n], self.starts[i + 1 : i + n + 1] = scores, at + np.cumsum(many)
        self.shown += shown
        self.index.update(zip(segments, range(i, i + n)))

    def numbers(self, segments: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))
        except KeyError:
            for group in self.lattices.segmented(list(set(segments).difference(self.index))):
                self.add(*group)
            return np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))

    def joined(self, segments: list[str]) -> tuple[float, np.ndarray]:
        """Score and ids of segments one after another."""
        numbers = self.numbers(segments)
        starts, many = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        before = np.cumsum(many) - many
        ids = self.flat[np.repeat(starts - before, many) + np.arange(many.sum())]
        return float(self.scores[numbers].sum()), ids

    def trim(self) -> None:
        if len(self.index) > CACHE_SEGMENTS or len(self.flat) > 16 * CACHE_SEGMENTS:
            self.clear()

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Of each text the number of ids and the score, all ids, and whether decoding gives the text."""
        split = [self.v.split(normalised(t)) for t in texts]
        numbers = self.numbers([s for own in split for s in own])
        many = self.starts[numbers + 1] - self.starts[numbers]
        before = np.concatenate([[0], np.cumsum(many)])
        ids = self.flat[np.repeat(self.starts[numbers] - before[:-1], many) + np.arange(before[-1])]
        ends = np.cumsum([0, *map(len, split)])
        scores = np.array([self.scores[numbers[a:b]].sum() for a, b in zip(ends[:-1], ends[1:])])
        shown = list(map(self.shown.__getitem__, numbers.tolist()))
        same = [b"".join(shown[a:b]).decode("utf-8", "surrogatepass")[1:] == t for a, b, t in zip(ends[:-1], ends[1:], texts)]
        self.trim()
        return before[ends[1:]] - before[ends[:-1]], scores, ids, same


def _whole(v: Vocabulary):
    def one(doc_ids: list, texts: list[str], segments: Segments) -> pa.RecordBatch:
        if any(SPACE in t for t in texts):
            coded = [encode_text(v, t) for t in texts]
            many, scores = np.array([len(i) for _, i in coded]), np.array([s for s, _ in coded])
            ids, same = np.concatenate([np.array(i, np.int32) for _, i in coded]), [decode(v, i) == t for (_, i), t in zip(coded, texts)]
        else:
            many, scores, ids, same = segments.encoded(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(ids, pa.int32()))
        columns = [doc_ids, list(map(len, texts)), [1] * len(texts), many, scores, lists, same]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def rows(batches):
        segments = Segments(v)
        for batch in batches:
            sizes = np.cumsum(pa.compute.utf8_length(batch.column(1)).to_numpy()) if batch.num_rows else np.zeros(0)
            at = 0
            while at < batch.num_rows:
                reached = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, reached + PASS_CHARS, side="right")))
                yield one(batch.column(0)[at:to].to_pylist(), batch.column(1)[at:to].to_pylist(), segments)
                at = to

    return rows


def _chunks(v: Vocabulary, size: int):
    """Chunks of giant texts. A text is cut at literal U+2581 before, which are written as bytes; these cuts need no state."""

    def rows(batches):
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                out, no = [], 0
                for part_no, part in enumerate(text.split(SPACE)):
                    written = (SPACE if part_no == 0 else "") + part.replace(" ", SPACE)
                    starts = list(range(0, max(len(written) - v.longest, 1), size))
                    for i, a in enumerate(starts):
                        last = i == len(starts) - 1
                        b = len(written) if last else a + size
                        out.append((key, doc_id, part_no, no, written[a:b], "" if last else written[b : b + v.longest - 1], last, len(text), digest))
                        no += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHUNKS)], schema=_CHUNKS)

    return rows


_CHUNKS = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("body", pa.string()), ("ahead", pa.string()), ("last", pa.bool_()), ("n_chars", pa.int64()), ("digest", pa.string())]
)
_CHUNKS_SQL = "key long, doc_id long, part int, chunk int, body string, ahead string, last boolean, n_chars long, digest string"


def _matrices(v: Vocabulary):
    def rows(batches):
        segments = Segments(v)
        for batch in batches:
            chunks = list(zip(*(batch.column(c).to_pylist() for c in ("body", "ahead", "last"))))
            m = _in_passes(v, [x[0] for x in chunks], segments, lambda n, cut: transfer(v, *chunks[n], segments, cut).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("chunk"), pa.array(m, pa.binary())], ["key", "part", "chunk", "m"])

    return rows


def _states(v: Vocabulary):
    def of(table: pa.Table) -> pa.Table:
        """Boundary states of one document's chunks: its matrices take less room than its text."""
        t = table.sort_by("chunk")
        part = t.column("part").to_numpy()
        out = []
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            m = np.array([np.frombuffer(t.column("m")[int(i)].as_py(), np.float64).reshape(v.longest, v.longest) for i in at])
            states, total = boundary_states(m)
            out += [(t.column("key")[int(i)].as_py(), t.column("chunk")[int(i)].as_py(), int(states[n]), int(states[n + 1]), total if n == 0 else 0.0) for n, i in enumerate(at)]
        names = ("key", "chunk", "enter", "leave", "score")
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names)

    return of


def _traced(v: Vocabulary):
    def rows(batches):
        segments = Segments(v)
        for batch in batches:
            chunks = list(zip(*(batch.column(c).to_pylist() for c in ("body", "ahead", "enter", "leave"))))
            ids = _in_passes(v, [x[0] for x in chunks], segments, lambda n, cut: backtrace(v, *chunks[n], segments, cut))
            keep = [batch.column(c) for c in ("key", "doc_id", "part", "chunk", "n_chars", "digest", "score")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(ids, pa.list_(pa.int32()))], ["key", "doc_id", "part", "chunk", "n_chars", "digest", "score", "ids"])

    return rows


def _put_together(v: Vocabulary):
    def of(table: pa.Table) -> pa.Table:
        t = table.sort_by("chunk")
        ids, score, before = [], 0.0, 0
        for part, s, x in zip(t.column("part").to_pylist(), t.column("score").to_pylist(), t.column("ids").to_pylist()):
            if part != before:
                ids += [v.bytes_[b] for b in SPACE.encode()]
                score, before = score + v.unknown, part
            ids.extend(x)
            score += s
        same = hashlib.sha256(decode(v, ids).encode("utf-8", "surrogatepass")).hexdigest() == t.column("digest")[0].as_py()
        row = (t.column("doc_id")[0].as_py(), t.column("n_chars")[0].as_py(), t.num_rows, len(ids), score, ids, same)
        return pa.table([pa.array([x], f.type) for x, f in zip(row, _ARROW)], schema=_ARROW)

    return of


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_chars, n_chunks, n_tokens, score (0 for no tokens), token_ids, round_trip (decoding gives the text).

    Only documents of more than ``chunk`` code points are shuffled: their chunks are dealt out, traced with their
    states, and put together; a document's ids take no more room than its text does. Null texts are empty: no tokens.
    Null and repeated ids are rows like others; an empty table gives no rows; other columns are not read.
    """
    v = vocabulary
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    giant = F.length("text") > chunk
    small = rows.where(~giant).mapInArrow(_whole(v), _ENCODED)
    keyed = rows.where(giant).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    # Written once, so that the keys stay the same if a task runs again.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = materialize(keyed.mapInArrow(_chunks(v, chunk), _CHUNKS_SQL).repartition(parts), "chunks")
    matrices = chunks.select("key", "part", "chunk", "body", "ahead", "last").mapInArrow(_matrices(v), "key long, part int, chunk int, m binary")
    states = matrices.groupBy("key").applyInArrow(_states(v), "key long, chunk int, enter int, leave int, score double")
    traced = chunks.join(states, ["key", "chunk"]).mapInArrow(
        _traced(v), "key long, doc_id long, part int, chunk int, n_chars long, digest string, score double, ids array<int>"
    )
    return small.union(traced.groupBy("key").applyInArrow(_put_together(v), _ENCODED))
