"""Phrases that occur often, by prefix-free parsing.

The words of each piece of text are cut at triggers, places whose two last words hash to a
multiple of ``TRIGGER``. A chunk runs from one trigger to the next and on over the following
``LONGEST - 1`` words, so chunks overlap and every phrase that starts in a chunk's own part
lies inside it: each occurrence belongs to one chunk. Equal places give equal chunks, however
often a passage is repeated: distinct chunks are the dictionary, with how often each occurs in
the parse, and phrases are counted in the dictionary alone, weighted by that.

Phrases are counted level by level. Those of ``k`` words are looked for only where both parts of
``k - 1`` words are frequent, as a bit table of hashes tells; the table may let others pass, and
each phrase is told by a 64-bit hash of language and words until one of its chunks gives its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain.llm.arrays import LOWER, Words, grams, grams_inside, mix64, slices, text_bytes
from sitegrain.llm.bits import bit_table, known
from sitegrain.plans.staging import Staging

LONGEST, FREQUENT, TOP = 5, 100, 2000
TRIGGER = 16
#: Hashes that a task holds before it hands its counts on.
HELD = 1 << 20
#: Characters that end a piece, and those between words.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"

_WORD = np.ones(256, bool)
_WORD[[ord(c) for c in BLANKS]] = False
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in BREAKS]] = True


def _spread(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... of each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def parse(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Chunks of all texts, lower-cased: text of each, chunk (words with one blank between), and how many
    of its words start phrases of its own."""
    raw, starts = text_bytes(texts)
    inside = _WORD[raw] & ~_BREAK[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int32)
    # Words with one blank after each.
    keep = inside.copy()
    keep[end] = True
    norm = np.where(inside, LOWER[raw], np.uint8(32))[keep]
    at = np.concatenate(([0], np.cumsum(end - start + 1)))
    word = Words(pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(norm)], np.int32)), pa.py_buffer(norm)), _WORD).hash
    text = np.searchsorted(starts, start, "right") - 1
    breaks = np.cumsum(_BREAK[raw])
    first = np.ones(len(start), bool)
    first[1:] = (text[1:] != text[:-1]) | (breaks[start[1:]] != breaks[end[:-1] - 1])
    piece_end = np.append(np.flatnonzero(first)[1:], len(start))[np.cumsum(first) - 1]
    trigger = first.copy()
    trigger[1:] |= mix64(word[1:] + word[:-1] * np.uint64(0x9FB21C651E98DF25)) % np.uint64(TRIGGER) == 0
    head = np.flatnonzero(trigger)
    own = np.diff(np.append(head, len(start)))
    last = np.minimum(head + own + LONGEST - 1, piece_end[head])
    size = at[last] - at[head] - 1
    out = norm[np.repeat(at[head], size) + _spread(size)]
    offsets = np.concatenate(([0], np.cumsum(size)))
    kind, wide = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
    chunks = pa.Array.from_buffers(kind, len(head), [None, pa.py_buffer(offsets.astype(wide)), pa.py_buffer(out)])
    return text[head], chunks, own.astype(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch["text"]):
            part = batch.slice(lo, hi - lo)
            text, chunk, own = parse(part["text"])
            t = pa.table({"lang": part["lang"].take(pa.array(text)), "chunk": chunk.cast(pa.string()), "own": own})
            yield from t.group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")]).select(["lang", "chunk", "own", "count_all"]).rename_columns(["lang", "chunk", "own", "freq"]).to_batches()


def dictionary(docs: DataFrame) -> DataFrame:
    """``lang, chunk, own, freq`` of the distinct chunks of ``docs`` (``lang``, ``text``); null counts as ``und`` and as empty."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    return rows.mapInArrow(_chunks, "lang string, chunk string, own int, freq long").groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq"))


def _text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


class _Level:
    """Phrases of ``k`` words at the own places of a batch of chunks: place, hash, and weight of each."""

    def __init__(self, part: pa.RecordBatch):
        self.words = Words(part["chunk"], _WORD)
        names = part["lang"].dictionary_encode()
        salt = np.array([_text_hash(t) for t in names.dictionary.to_pylist()], np.uint64)
        own, first = part["own"].to_numpy(), self.words.first
        row = self.words.text_of_word()
        self.salt = salt[names.indices.to_numpy()][row] if len(row) else np.zeros(0, np.uint64)
        self.weight = part["freq"].to_numpy()[row]
        # A number for each chunk, by its words, language and own places.
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(self.words.hash + np.arange(len(row), dtype=np.uint64) - first[row].astype(np.uint64)))))
        self.chunk = mix64((sums[first[1:]] - sums[first[:-1]])[row] ^ self.salt ^ own[row].astype(np.uint64))
        self.mine = np.arange(len(row)) - first[row] < own[row]

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of ``k`` words begin, by own places or not, and the hash at each word."""
        h = grams(self.words.hash, k)
        return np.flatnonzero(grams_inside(self.words.first, len(self.words.hash), k)), mix64(h ^ self.salt[: len(h)])


def _candidates(level: _Level, k: int, shared: list) -> tuple[np.ndarray, np.ndarray]:
    """Own places of phrases of ``k`` words both of whose parts may be frequent, and their hashes."""
    at, h = level.places(k)
    at = at[level.mine[at]]
    if k > 1:
        bits = shared[k - 2].value
        _, part = level.places(k - 1)
        at = at[known(bits, part[at])]
        at = at[known(bits, part[at + 1])]
    return at, h[at]


class _Counts:
    """Hashes of a task, how often each occurs, and a chunk that has it; added up over batches in bounded memory."""

    def __init__(self):
        self.g, self.n, self.at, self.held = [], [], [], 0

    def add(self, h: np.ndarray, weight: np.ndarray, chunk: np.ndarray) -> None:
        g, where, of = np.unique(h, return_index=True, return_inverse=True)
        n = np.zeros(len(g), np.int64)
        np.add.at(n, of, weight)
        self.g.append(g)
        self.n.append(n)
        self.at.append(chunk[where])
        self.held += len(g)
        if self.held > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        g, n, at = np.concatenate(self.g), np.concatenate(self.n), np.concatenate(self.at)
        order = np.argsort(g, kind="stable")
        g, n, at = g[order], n[order], at[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), g[1:] != g[:-1])))
        self.g, self.n, self.at = [g[first]], [np.add.reduceat(n, first) if len(first) else n], [at[first]]
        self.held = len(first)

    def out(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.g[0].view(np.int64)), pa.array(self.n[0]), pa.array(self.at[0].view(np.int64))], ["g", "n", "at"])

    def full(self) -> bool:
        return self.held > HELD


def _count(k: int, shared: list) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for lo, hi in slices(batch["chunk"]):
                level = _Level(batch.slice(lo, hi - lo))
                at, h = _candidates(level, k, shared)
                counts.add(h, level.weight[at], level.chunk[at])
                if counts.full():
                    counts.merge()
                    if counts.full():
                        yield counts.out()
                        counts = _Counts()
        if counts.held:
            counts.merge()
            yield counts.out()

    return run


def _phrases(levels: int, shared: list, places) -> Callable:
    """Words of phrases, each where the table of ``places`` (hash and chunk) has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["chunk"]):
                part = batch.slice(lo, hi - lo)
                level = _Level(part)
                w, row = level.words, level.words.text_of_word()
                for k in range(1, levels + 1):
                    at, h = _candidates(level, k, shared)
                    place = mix64(h ^ level.chunk[at])
                    may = known(places.value, place) & known(places.value, mix64(place))
                    begin, h = at[may], h[may]
                    phrases = [w.data[s:e].tobytes().decode() for s, e in zip(w.start[begin].tolist(), w.end[begin + k - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), part["lang"].take(pa.array(row[begin])), pa.array(phrases, pa.string()), pa.array(np.full(len(h), k, np.int32))], ["g", "lang", "phrase", "k"]
                    )

    return run


def _place_table(often: DataFrame) -> np.ndarray:
    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = mix64(b["g"].to_numpy().view(np.uint64) ^ b["at"].to_numpy().view(np.uint64))
            # Two slots each, so that one row in 256 passes by chance.
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((place, mix64(place))).view(np.int64))], ["g"])

    return bit_table(often.select("g", "at").mapInArrow(mix, "g long"))


def frequent_phrases(chunks: DataFrame, stage: Staging, least: int, longest: int) -> DataFrame:
    """``lang, phrase, k, f`` of every phrase of up to ``longest`` words that occurs ``least`` times or more."""
    context, shared, levels = chunks.sparkSession.sparkContext, [], []
    for k in range(1, longest + 1):
        counted = chunks.mapInArrow(_count(k, list(shared)), "g long, n long, at long").groupBy("g").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
        often = stage.write(counted.where(F.col("n") >= least), f"level{k}")
        levels.append(often)
        if often.isEmpty():
            break
        shared.append(context.broadcast(bit_table(often)))
    often = reduce(DataFrame.unionByName, levels)
    places = context.broadcast(_place_table(often))
    found = chunks.mapInArrow(_phrases(len(shared), list(shared), places), "g long, lang string, phrase string, k int")
    # One chunk of each phrase gives its words; few others pass the table, and agree.
    named = found.groupBy("g").agg(F.min(F.struct("lang", "phrase", "k")).alias("x"))
    out = stage.write(often.join(named, "g").select("x.lang", "x.phrase", "x.k", F.col("n").alias("f")), "phrases")
    for b in (*shared, places):
        b.unpersist()
    return out


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, stage: Staging, least: int = FREQUENT, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Null ``lang`` counts as ``und`` and null text as empty; a language without words gives no row. Repeated
    rows count each. Ties are broken by count and then by bytes of the phrase, so ranks are the same in each
    run. Other columns of ``docs`` are not looked at. Products
    are exact decimals of 38 digits.
    """
    if longest > LONGEST:
        raise ValueError(f"chunks overlap for phrases of {LONGEST} words")
    chunks = stage.write(dictionary(docs), "dictionary")
    total = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    often = frequent_phrases(chunks, stage, least, longest)
    split = often.where("k > 1").withColumn("w", F.split("phrase", " "))
    # A longer candidate that occurs as often as a part of it takes the part's place.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: _part(F.col("w"), s, m))))
    covered = split.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("c"), _part(F.col("w"), 1, c).alias("p"), _part(F.col("w"), c + 1, F.col("k") - c).alias("q"))))
    kept = split.join(covered, ["lang", "phrase"], "left").where("_longer IS NULL OR _longer < f")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), cut.alias("x")).select("lang", "phrase", "a", "x.c", "x.p", "x.q")
    f = often.select("lang", F.col("phrase").alias("p"), F.col("f").alias("l"))
    g = often.select("lang", F.col("phrase").alias("q"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(f, ["lang", "p"]).join(g, ["lang", "q"]).join(total, "lang").withColumns({"_up": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "_down": wide("l") * wide("r")})
    best = (
        scored.groupBy("lang", "phrase")
        .agg(F.min(F.struct(F.expr("_up div _down").alias("score"), "c", "l", "r", "a", "n")).alias("x"))
        .select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
