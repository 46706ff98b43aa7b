"""A log-bilinear language model with noise-contrastive estimation.

The model predicts a token's class from the classes of the two tokens before it: the end
of a text and the most frequent words are classes of their own, other words share classes
by their last two bytes. Inside a class a word has its share of the training counts, with
one count for a word never seen, so token probabilities sum to one. Every task trains on
its own tokens from the same start and parameters are averaged by tokens; Spark counts
words and looks up what is too rare to be sent along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.arrays import NOT_SPACE, Words, mix64, slices
from sitegrain.plans.staging import Staging

CLASSES, SUFFIXES, WIDTH, NOISE, BATCH = 256, 64, 16, 16, 4096
FREQUENT = CLASSES - SUFFIXES - 1
#: Words sent to every task with their counts, at most (16 MiB); the rest are joined.
KNOWN_WORDS = 1 << 20


def held_out(doc_id: Column, mod: int = 7, rest: int = 2) -> Column:
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def suffix_class(w: Words) -> np.ndarray:
    """Class of a word that has none of its own, by its last two bytes."""
    last = w.data[w.end - 1].astype(np.uint64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (CLASSES - SUFFIXES + (mix64(last * np.uint64(257) + before) % np.uint64(SUFFIXES)).astype(np.int64)).astype(np.int16)


def _merged(hashes: list[np.ndarray], classes: list[np.ndarray], counts: list[np.ndarray]):
    h, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return h, np.concatenate(classes)[at], np.bincount(inverse, np.concatenate(counts), len(h)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, classes, counts, held = [], [], [], 0

    def out():
        h, c, n = _merged(hashes, classes, counts)
        for lo in range(0, len(h), 1 << 17):
            s = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(c[s]), pa.array(n[s])], ["word", "class", "n"])

    for batch in batches:
        for lo, hi in slices(batch["text"]):
            w = Words(batch["text"].slice(lo, hi - lo), NOT_SPACE)
            h, at, n = np.unique(w.hash, return_index=True, return_counts=True)
            hashes.append(h), classes.append(suffix_class(w)[at]), counts.append(n)
            held += len(h)
            if held > 1 << 21:  # keep what a task holds bounded
                h, c, n = _merged(hashes, classes, counts)
                hashes, classes, counts, held = [h], [c], [n], len(h)
                if held > 1 << 20:
                    yield from out()
                    hashes, classes, counts, held = [], [], [], 0
    if hashes:
        yield from out()


@dataclass
class Vocabulary:
    """What tasks need of the training counts."""

    frequent: np.ndarray  # hashes of words with a class of their own, ascending
    frequent_class: np.ndarray
    known: np.ndarray  # hashes of words sent along, ascending
    known_n: np.ndarray
    below: int  # words with fewer counts are not sent along
    mass: np.ndarray  # per class: counts of its words, one added to each, and one
    log_unigram: np.ndarray
    tokens: int  # N
    distinct: int  # V
    docs: int

    def classes(self, w: Words) -> np.ndarray:
        out = suffix_class(w)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, w.hash), len(self.frequent) - 1)
            own = self.frequent[at] == w.hash
            out[own] = self.frequent_class[at[own]]
        return out


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """From ``word, class, n``. What comes to the driver is bounded by ``CLASSES`` and ``KNOWN_WORDS``."""
    powers = [1 << j for j in range(63)]
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.array(*[F.count_if(F.col("n") >= p) for p in powers]).alias("many")).first()
    below = next(p for p, many in zip(powers, row["many"], strict=True) if many <= KNOWN_WORDS)
    sent = counts.where(F.col("n") >= below).select("word", "n").toArrow()
    words, n = sent["word"].to_numpy().view(np.uint64), sent["n"].to_numpy()
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "class", "n").collect()
    own = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    by_hash = np.argsort(own)
    words, order = np.unique(np.concatenate((words, own)), return_index=True)
    n = np.concatenate((n, np.array([r["n"] for r in top], np.int64)))[order]
    mass, per_class = np.ones(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum(F.col("n") + 1).alias("m"), F.sum("n").alias("n")).collect():
        mass[r["class"]] += r["m"]
        per_class[r["class"]] += r["n"]
    for i, r in enumerate(top):
        mass[r["class"]] -= r["n"] + 1
        per_class[r["class"]] -= r["n"]
        per_class[1 + i] = r["n"]
    mass[: CLASSES - SUFFIXES] = 1
    per_class[0] = n_docs
    unigram = (per_class + 1) / (per_class.sum() + CLASSES)
    return Vocabulary(
        own[by_hash], (1 + by_hash).astype(np.int16), words, n, below, mass, np.log(unigram).astype(np.float32),
        (row["n"] or 0) + n_docs, row["v"] + (1 if n_docs else 0), n_docs,
    )


def _stream(w: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens with an end after each text, and the text of each token."""
    n = w.counts() + 1
    tokens = np.zeros(int(n.sum()), np.int16)
    ends = np.cumsum(n) - 1
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = classes
    return tokens, np.repeat(np.arange(len(n)), n)


def _contexts(tokens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before and the one before that; class 0 before a text begins."""
    one, two = np.zeros_like(tokens), np.zeros_like(tokens)
    same = text[1:] == text[:-1]
    one[1:] = np.where(same, tokens[:-1], 0)
    two[2:] = np.where(text[2:] == text[:-2], tokens[:-2], 0)
    return one, two


class LogBilinear:
    """Scores of the next class: (context embeddings, each weighted by place) · (class embedding)
    plus a bias that starts at the unigram."""

    def __init__(self, log_unigram: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.c = np.ones((2, WIDTH), np.float32)
        self.b = log_unigram.astype(np.float32).copy()

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def train(self, one, two, target, log_unigram, seed: int, rate: float = 0.05) -> None:
        """One pass of noise-contrastive estimation, noise from the unigram, shared in a batch."""
        rng = np.random.default_rng(seed)
        noise_p = np.exp(log_unigram.astype(np.float64))
        cumulative = np.cumsum(noise_p / noise_p.sum())
        shift = log_unigram + np.log(NOISE)
        if not hasattr(self, "past"):
            self.past = [np.full(p.shape, 1e-2, np.float32) for p in self.parts()]

        def scattered(ids, rows):
            return np.stack([np.bincount(ids, rows[:, d], CLASSES) for d in range(WIDTH)], 1)

        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        for lo in range(0, len(target), BATCH):
            h1, h2, w = one[lo : lo + BATCH], two[lo : lo + BATCH], target[lo : lo + BATCH]
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), CLASSES - 1)
            e1, e2 = self.r[h1], self.r[h2]
            h = e1 * self.c[0] + e2 * self.c[1]
            q, qn = self.q[w], self.q[noise]
            real = 1 - sigmoid((h * q).sum(1) + self.b[w] - shift[w])
            fake = -sigmoid(h @ qn.T + self.b[noise] - shift[noise])
            gh = real[:, None] * q + fake @ qn
            n = np.float32(1 / len(w))
            gq = scattered(w, real[:, None] * h)
            np.add.at(gq, noise, fake.T @ h)
            gb = np.bincount(w, real, CLASSES) + np.bincount(noise, fake.sum(0), CLASSES)
            gr = scattered(h1, gh * self.c[0]) + scattered(h2, gh * self.c[1])
            gc = np.stack([(gh * e1).sum(0), (gh * e2).sum(0)])
            for p, g, s in zip(self.parts(), (gr, gq, gc, gb), self.past, strict=True):
                g = (g * n).astype(np.float32)
                s += g * g
                p += rate * g / np.sqrt(s)

    def log_probabilities(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log probabilities of all classes, a row per context, by one matrix product."""
        s = (self.r[one] * self.c[0] + self.r[two] * self.c[1]) @ self.q.T + self.b
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def _trainer(vocab: Vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n, step = LogBilinear(vocab.log_unigram), 0, 0
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                w = Words(batch["text"].slice(lo, hi - lo), NOT_SPACE)
                tokens, text = _stream(w, vocab.classes(w))
                model.train(*_contexts(tokens, text), tokens, vocab.log_unigram, step)
                n, step = n + len(tokens), step + 1
        if n:
            flat = model.flat().astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), n, np.float64))], ["i", "v", "n"])

    return run


def _scorer(vocab: Vocabulary, flat: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear(vocab.log_unigram).load(flat)
        log_mass, known_log = np.log10(vocab.mass), np.log10(vocab.known_n + 1.0)
        end_log = np.log10(vocab.docs + 1.0)
        total_log = np.log10(float(vocab.tokens + vocab.distinct + 1))
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                w = Words(part["text"], NOT_SPACE)
                classes = vocab.classes(w)
                tokens, text = _stream(w, classes)
                one, two = _contexts(tokens, text)
                context = one.astype(np.int32) * CLASSES + two
                distinct, inverse = np.unique(context, return_inverse=True)
                token_log = np.empty(len(tokens), np.float64)
                order = np.argsort(inverse, kind="stable")
                at = 0
                for k in range(0, len(distinct), 4096):  # a batch of contexts at a time
                    d = distinct[k : k + 4096]
                    table = model.log_probabilities(d // CLASSES, d % CLASSES)
                    upto = at + int(np.searchsorted(inverse[order[at:]], k + len(d)))
                    rows = order[at:upto]
                    token_log[rows] = table[inverse[rows] - k, tokens[rows]]
                    at = upto
                n = len(part)
                score = np.bincount(text, token_log, n) / np.log(10)
                of = w.text_of_word()
                rare = classes >= CLASSES - SUFFIXES
                score -= np.bincount(of[rare], log_mass[classes[rare]], n)
                h, inv = np.unique(w.hash, return_inverse=True)
                if len(vocab.known):
                    k = np.minimum(np.searchsorted(vocab.known, h), len(vocab.known) - 1)
                    seen = vocab.known[k] == h
                    logs = np.where(seen, known_log[k], 0.0)
                else:
                    seen, logs = np.zeros(len(h), bool), np.zeros(len(h))
                seen, logs = seen[inv], logs[inv]
                base = np.bincount(of, logs, n) + end_log - (w.counts() + 1) * total_log
                score += np.bincount(of[rare], logs[rare], n)
                rest = pa.array(w.hash[~seen].view(np.int64))
                offsets = pa.array(np.searchsorted(of[~seen], np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(w.counts() + 1, pa.int64()), pa.array(np.bincount(of[seen], minlength=n) + int(vocab.docs > 0), pa.int64()), pa.array(base), pa.array(score), pa.ListArray.from_arrays(offsets, rest)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"],
                )

    return run


def fit(train: DataFrame, stage: Staging) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """Counts of all training words, the vocabulary, and the averaged parameters."""
    counted = train.select("text").mapInArrow(_count, "word long, class short, n long")
    counts = stage.write(counted.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n")), "counts")
    vocab = vocabulary(counts, train.count())
    rows = train.select("text").mapInArrow(_trainer(vocab), "i long, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("i").collect()
    flat = np.array([r["v"] for r in rows]) if rows else LogBilinear(vocab.log_unigram).flat()
    return counts, vocab, flat


def score_report(docs: DataFrame, stage: Staging, mod: int = 7, rest: int = 2) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows whose crc32 of ``doc_id`` leaves another remainder than ``rest`` by ``mod``; a null
    id counts as the empty text. Null and empty texts are one token, the end. Without any training row
    the scores are those of an empty count table. Repeated rows count as often as they occur.
    Words are told apart by 64-bit hashes.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), mod, rest).alias("held_out"))
    counts, vocab, flat = fit(rows.where("NOT held_out"), stage)
    id_type = dict(docs.dtypes)["doc_id"]
    scored = stage.write(
        rows.mapInArrow(_scorer(vocab, flat), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<long>").withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "scored",
    )
    # Words too rare to be sent along; those with a class of their own are always sent along.
    looked_up = (
        scored.select("_row", F.explode("rest").alias("word"))
        .join(counts.where(F.col("n") < vocab.below).select("word", "n"), "word")
        .groupBy("_row")
        .agg(F.count(F.lit(1)).alias("_known"), F.sum(F.log10(F.col("n") + 1)).alias("_log"))
    )
    log = F.coalesce("_log", F.lit(0.0))
    return scored.join(looked_up, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + log).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )
