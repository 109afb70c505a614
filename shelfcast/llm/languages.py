"""Language of documents and of the spans inside them.

Per-word scores are sums of log probabilities of the word's character trigrams and of the word itself, in a table of
``SLOTS`` hashed features per language. The script of a word (a range of code points) narrows its candidates
to the languages that were seen in that script. A Viterbi pass over the words, with a penalty for each switch
of language, labels spans; the document's language is the one that labels most letters.
"""

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import bounded_sample

SLOTS = 1 << 15
#: Labelled documents from which the scores are learned, at most (about; chosen by a hash of the id).
SAMPLE_ROWS = 20_000
SWITCH_PENALTY = 14.0
#: Share of a language's words in a script from which the script counts as its own.
SCRIPT_SHARE = 0.001
#: Words whose scores are kept in a task, and words labelled in one pass.
CACHE_WORDS, PASS_WORDS = 300_000, 1_000_000

LETTERS = re.compile(r"[^\W\d_]+")
#: First code points of Unicode script ranges; "" is a range without one of these scripts.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, ""), (0x0B80, "Tamil"),
    (0x0C00, ""), (0x0E00, "Thai"), (0x0E80, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"),
    (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
#: crc32 of every byte, from which that of longer runs is made.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def ranges(words: list[str]) -> np.ndarray:
    """Place in ``SCRIPTS`` of each word's last letter; -1 if it lies before the first."""
    return np.searchsorted(_STARTS, np.fromiter((ord(w[-1]) for w in words), np.int64, len(words)), side="right") - 1


def _trigram_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of the bytes from each start to its end, byte by byte for all at once."""
    crc, sizes = np.full(len(starts), 0xFFFFFFFF, np.uint32), ends - starts
    for k in range(int(sizes.max(initial=0))):
        on = slice(None) if k < 3 else np.flatnonzero(sizes > k)
        crc[on] = _CRC[(crc[on] ^ data[starts[on] + k]) & 0xFF] ^ crc[on] >> 8
    return ~crc


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words one after another (a word's own, then those of its trigrams), and their number per word."""
    folded = [f"^{w.casefold()}$" for w in words]
    written = "".join(folded).encode()
    data = np.frombuffer(written, np.uint8)
    places = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where characters begin
    sizes = np.fromiter(map(len, folded), np.int64, len(folded))
    many = sizes - 1
    own = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.int64)
    trigram = np.ones(len(out), bool)
    trigram[own] = False
    out[own] = [zlib.crc32(w.encode()) % SLOTS for w in folded]
    at = (np.arange(len(out)) + np.repeat(np.cumsum(sizes) - sizes - own - 1, many))[trigram]
    out[trigram] = _trigram_crcs(data, places[at], places[at + 3]) % SLOTS
    return out, many


def words(text: str | None) -> list[str]:
    """Runs of letters. The pattern also admits number signs, so runs without a letter are left out."""
    found = LETTERS.findall(text) if text else []
    return found if not text or text.isascii() else [w for w in found if w.isascii() or any(map(str.isalpha, w))]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # SLOTS x languages: log probabilities
    scripts: dict[str, np.ndarray]  # script: penalty per language

    def scores(self, words: list[str]) -> np.ndarray:
        """One row per word: its features' sum, added in their order, for all words side by side, and its script's penalty."""
        slots, many = features(words)
        order = np.argsort(-many, kind="stable")
        starts, run = (np.cumsum(many) - many)[order], many[order]
        total = np.zeros((len(words), len(self.langs)), np.float32)
        for k in range(int(run[0]) if len(run) else 0):
            n = len(run) - int(np.searchsorted(run[::-1], k, side="right"))
            total[:n] += self.table[slots[starts[:n] + k]]
        barred = np.array([self.scripts.get(s, np.zeros(len(self.langs))) for _, s in (*SCRIPTS, (None, ""))])
        out = np.empty_like(total)
        out[order] = total
        return (out + barred[ranges(words)]).astype(np.float32)


def fit(labelled: DataFrame, text_col: str, lang_col: str, id_col: str) -> Model:
    """Feature counts per language over a bounded sample. What reaches the driver is languages x ``SLOTS`` sums."""
    sample = bounded_sample(labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, SAMPLE_ROWS)

    def counts(batches):
        slots, scripts = {}, Counter()
        held: dict[str, Counter] = {}

        def add():
            for lang, seen in held.items():
                found, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
                own, many = features(found)
                slots[lang] = slots.get(lang, 0) + np.bincount(own, np.repeat(n, many), SLOTS)
                at = ranges(found) % (len(SCRIPTS) + 1)
                for i, k in enumerate(np.bincount(at, n, len(SCRIPTS) + 1).tolist()):
                    if k:
                        scripts[lang, SCRIPTS[i][1] if i < len(SCRIPTS) else ""] += int(k)
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(words(text))
                if sum(map(len, held.values())) > CACHE_WORDS:
                    add()
        add()
        rows = [(lang, f, None, int(own[f])) for lang, own in slots.items() for f in np.flatnonzero(own).tolist()]
        rows += [(lang, None, s, n) for (lang, s), n in scripts.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "slot", "script", "n"), r)) for r in rows], schema=_COUNTS)

    sums = (
        sample.select(F.col(text_col), F.col(lang_col))
        .mapInArrow(counts, "lang string, slot int, script string, n long")
        .groupBy("lang", "slot", "script")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(sums["lang"].unique())
    table, by_script = np.full((SLOTS, len(langs)), 0.2), {}
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        slots, used = own[own["slot"].notna()], own[own["script"].notna()]
        table[slots["slot"].to_numpy(int), i] += slots["n"].to_numpy(float)
        for s, n in zip(used["script"], used["n"]):
            if n >= SCRIPT_SHARE * used["n"].sum():
                by_script.setdefault(s, np.full(len(langs), -50.0))[i] = 0.0
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), by_script)


_COUNTS = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("script", pa.string()), ("n", pa.int64())])


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language of each word for several texts at once; ``scores`` has their words one text after another.

    All texts advance together, the longest first, so a step is one operation on an array over the texts that
    are still running. Ties stay with the language of the word before, then go to the first language.
    """
    order = np.argsort(-lengths, kind="stable")
    run = lengths[order]
    steps = int(run[0]) if len(run) else 0
    starts = (np.cumsum(lengths) - lengths)[order]
    active = len(run) - np.searchsorted(run[::-1], np.arange(steps), side="right")
    back = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int32)
    best = np.zeros((len(run), scores.shape[1]), np.float64)
    own = np.arange(scores.shape[1], dtype=back.dtype)
    origin = np.zeros(scores.shape, back.dtype)
    for t in range(steps):
        n = active[t]
        v = best[:n]
        if t:
            top = v.argmax(axis=1)
            level = v[np.arange(n), top] - penalty
            stay = v >= level[:, None]
            origin[starts[:n] + t] = np.where(stay, own, top[:, None].astype(back.dtype))
            np.maximum(v, level[:, None], out=v)
        v += scores[starts[:n] + t]
    state = best.argmax(axis=1).astype(back.dtype)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        back[at] = state[:n]
        if t:
            state[:n] = origin[at, state[:n]]
    return back


def _spans(labels: np.ndarray, langs: list[str]) -> str:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *cuts.tolist(), len(labels)]
    return ",".join(f"{langs[labels[a]]}:{a}-{b}" for a, b in zip(edges, edges[1:]))


def _labelled(model: Model):
    langs = model.langs

    def label(batches):
        index: dict[str, int] = {}
        rows = np.zeros((1024, len(langs)), np.float32)
        letters = np.zeros(1024, np.int32)

        def ids(found: list[list[str]]) -> np.ndarray:
            """Numbers of the words of several texts; new words are scored together."""
            nonlocal rows, letters
            new = list(set().union(*found).difference(index)) if langs else []
            if new:
                while len(index) + len(new) > len(rows):
                    rows, letters = np.concatenate([rows, np.zeros_like(rows)]), np.concatenate([letters, np.zeros_like(letters)])
                at = len(index)
                rows[at : at + len(new)], letters[at : at + len(new)] = model.scores(new), list(map(len, new))
                index.update(zip(new, range(at, at + len(new))))
            return np.fromiter(map(index.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))

        def flush(held):
            lengths = np.array([len(x) for _, x in held], np.int64)
            flat = ids([x for _, x in held])
            labels = viterbi(rows[flat], lengths) if langs else flat
            out, at = [], 0
            for (head, x), n in zip(held, lengths):
                if n and langs:
                    own = labels[at : at + n]
                    share = np.bincount(own, letters[flat[at : at + n]], len(langs))
                    top = int(share.argmax())
                    out.append((*head, langs[top], float(share[top] / share.sum()), _spans(own, langs)))
                else:
                    out.append((*head, "und", 0.0, None))
                at += n
            columns = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LABELS)], schema=_LABELS)

        for batch in batches:
            held, total = [], 0
            for doc_id, held_out, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = words(text) if langs else []
                held.append(((doc_id, held_out), x))
                total += len(x)
                if total >= PASS_WORDS:
                    yield flush(held)
                    held, total = [], 0
                    if len(index) > CACHE_WORDS:
                        index.clear()
            yield flush(held)
            if len(index) > CACHE_WORDS:
                index.clear()

    return label


_LABELS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.string())])


def predict(model: Model, docs: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (share of letters labelled so), spans (language:first-end in words).

    Null texts, texts without a letter, and all texts if nothing was learned, are ``und`` with score 0 and null spans.
    Ids may be null or repeated; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long"), held_out.alias("held_out"), F.col(text_col))
    schema = T.StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double, spans string")
    return rows.mapInArrow(_labelled(model), schema)
