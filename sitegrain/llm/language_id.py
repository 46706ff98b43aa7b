"""Language identification of mixed text.

A word's scripts narrow the languages it may be in; character trigrams and the word itself
score those that are left; Viterbi with a penalty for each switch labels the words of a
text, and runs of one label are its spans. A document has the language of most of its letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets for features; a model has this many numbers per language, whatever it learns from.
BUCKETS = 1 << 16
UNKNOWN = "und"

# First and last code point of ranges of letters, by script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
N_SCRIPTS = len(SCRIPTS) + 1

_tables: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None


def _character_tables():
    """Per code point: part of a word, letter, script, lower case."""
    global _tables
    if _tables is None:
        chars = [chr(c) for c in range(0x110000)]
        letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        part = letter | np.fromiter((unicodedata.category(c)[0] == "M" for c in chars), bool, len(chars))
        lower = np.arange(len(chars), dtype=np.uint32)
        for c in np.flatnonzero(letter):
            small = chars[c].lower()
            if len(small) == 1:
                lower[c] = ord(small)
        script = np.zeros(len(chars), np.uint8)
        for i, ranges in enumerate(SCRIPTS.values()):
            for lo, hi in ranges:
                script[lo : hi + 1] = i + 1
        _tables = part, letter, script, lower
    return _tables


class LetterWords:
    """Words (runs of letters and marks) of a piece of text: place, features, script, letters."""

    def __init__(self, text: str):
        part, letter, script, lower = _character_tables()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = part[points]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        at = np.flatnonzero(inside)
        c = (lower[points] * inside).astype(np.uint64)  # 0 outside words, so borders are in the trigrams
        padded = np.concatenate((np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)))
        code = (padded[at] << np.uint64(42)) | (padded[at + 1] << np.uint64(21)) | padded[at + 2]
        self.trigram = _bucket(code)
        self.word_of = np.repeat(np.arange(len(self.start)), self.end - self.start)
        self.offset = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.end - self.start)))[:-1]
        if len(self.start):
            weight = code * np.uint64(0x9E3779B97F4A7C15)
            self.word = _bucket(np.add.reduceat(weight ^ (weight >> np.uint64(29)), self.offset))
            letters = letter[points[at]]
            self.letters = np.add.reduceat(letters.astype(np.int64), self.offset)
            counts = np.bincount(self.word_of * N_SCRIPTS + script[points[at]], letters, len(self.start) * N_SCRIPTS)
            self.script = counts.reshape(-1, N_SCRIPTS).argmax(1)
        else:
            self.word = self.letters = self.script = np.zeros(0, np.int64)


def _bucket(code: np.ndarray) -> np.ndarray:
    h = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64)


def pieces(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Text in pieces of about ``most`` characters. Each piece joins short texts, or is a part of
    a long one cut at a blank; with it come the index of each text in it and where it starts."""
    held, rows, starts, size = [], [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        lo = 0
        while True:
            hi = len(text)
            if hi - lo > most:
                hi = max(text.rfind(" ", lo, lo + most), text.rfind("\n", lo, lo + most))
                hi = lo + most if hi <= lo else hi
            if size and size + hi - lo > most:
                yield "\n".join(held), np.array(rows), np.array(starts)
                held, rows, starts, size = [], [], [], 0
            held.append(text[lo:hi]), rows.append(i), starts.append(size)
            size += hi - lo + 1
            lo = hi
            if lo >= len(text):
                break
    if held:
        yield "\n".join(held), np.array(rows), np.array(starts)


@dataclass
class Model:
    """Log probabilities of features (bucket by language) and scripts that a language uses."""

    langs: list[str]
    log: np.ndarray
    uses: np.ndarray

    def score(self, w: LetterWords) -> np.ndarray:
        """Per word and language. Languages that do not use the word's script are out, unless none does."""
        s = np.add.reduceat(self.log[w.trigram], w.offset, axis=0) + self.log[w.word]
        allowed = self.uses[w.script]
        return np.where(allowed | ~allowed.any(1, keepdims=True), s, np.float32(-1e4))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. All texts advance by one word at a time, longest texts first."""
    n, counts = len(scores), np.diff(first)
    order = np.argsort(-counts, kind="stable")
    starts, counts = first[:-1][order], counts[order]
    label = np.zeros(n, np.int16)
    if not n:
        return label
    best = np.zeros(n, np.int16)
    stay = np.zeros(scores.shape, bool)
    longest = int(counts[0])
    active = np.searchsorted(-counts, -np.arange(longest), "left")  # texts with more than t words
    value = np.zeros((len(counts), scores.shape[1]), np.float32)
    value[: active[0]] = scores[starts[: active[0]]]
    for t in range(1, longest):
        a = active[t]
        at, v = starts[:a] + t, value[:a]
        b = v.argmax(1)
        jump = (v[np.arange(a), b] - penalty)[:, None]
        keep = v >= jump
        best[at], stay[at] = b, keep
        value[:a] = np.where(keep, v, jump) + scores[at]
        if t % 4096 == 0:
            value[:a] -= value[:a].max(1, keepdims=True)
    state = value.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        label[at] = state[:a]
        if t:
            state[:a] = np.where(stay[at, state[:a]], state[:a], best[at])
    return label


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = BUCKETS + N_SCRIPTS
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for text, rows, starts in pieces(batch["text"].to_pylist()):
            w = LetterWords(text)
            if not len(w.start):
                continue
            row = rows[np.searchsorted(starts, w.start, "right") - 1]
            names, lang = np.unique([langs[r] for r in rows], return_inverse=True)
            of_row = np.zeros(int(rows.max()) + 1, np.int64)
            of_row[rows] = lang
            lang_of_word = of_row[row]
            for i, name in enumerate(names):
                mine = lang_of_word == i
                chars = mine[w.word_of]
                total = counts.setdefault(str(name), np.zeros(width, np.int64))
                total[:BUCKETS] += np.bincount(w.trigram[chars], minlength=BUCKETS) + np.bincount(w.word[mine], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(w.script[mine], w.letters[mine], N_SCRIPTS).astype(np.int64)
    for name, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "feature", "n"])


def fit(labelled: DataFrame, script_share: float = 0.01) -> Model:
    """From ``text, lang`` of all rows with a language. Tasks add up features, Spark adds up tasks;
    the driver gets at most ``BUCKETS`` + scripts numbers per language."""
    counts = (
        labelled.where("lang IS NOT NULL AND text IS NOT NULL")
        .select("text", F.col("lang").cast("string").alias("lang"))
        .mapInArrow(_count, "lang string, feature int, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sorted(set(counts["lang"].to_pylist()))
    dense = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    index = {name: i for i, name in enumerate(langs)}
    dense[counts["feature"].to_numpy(), np.array([index[x] for x in counts["lang"].to_pylist()], int)] = counts["n"].to_numpy()
    grams, scripts = dense[:BUCKETS], dense[BUCKETS:]
    log = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, log, scripts >= np.maximum(scripts.sum(0) * script_share, 1))


def label(texts: list[str | None], model: Model, penalty: float):
    """Labels of the words of each text: index of text, first and last character, label, letters."""
    all_rows, all_start, all_end, all_scores, all_letters = [], [], [], [], []
    shift = np.zeros(len(texts), np.int64)  # characters of a text that earlier pieces had
    for text, rows, starts in pieces(texts):
        w = LetterWords(text)
        k = np.searchsorted(starts, w.start, "right") - 1
        row = rows[k] if len(k) else np.zeros(0, np.int64)
        all_rows.append(row)
        all_start.append(w.start - starts[k] + shift[row])
        all_end.append(w.end - starts[k] + shift[row])
        all_scores.append(model.score(w) if len(w.start) else np.zeros((0, len(model.langs)), np.float32))
        all_letters.append(w.letters)
        shift[rows] += np.diff(np.append(starts, len(text) + 1)) - 1
    rows = np.concatenate(all_rows)
    first = np.searchsorted(rows, np.arange(len(texts) + 1))
    return rows, np.concatenate(all_start), np.concatenate(all_end), viterbi(np.concatenate(all_scores), first, penalty), np.concatenate(all_letters)


def _spans(row, start, end, label, names, n):
    """Runs of one label: first and last character and language, per text."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1 if len(at) else at
    runs = pa.StructArray.from_arrays(
        [pa.array(start[at], pa.int64()), pa.array(end[last], pa.int64()), pa.array([names[i] for i in label[at]], pa.string())], ["start", "end", "lang"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(n + 1)), pa.int32()), runs)


def _predictor(model: Model, penalty: float, with_spans: bool, most_words: int = 1 << 20) -> Callable:
    n_langs = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            lengths = np.cumsum([len(t.as_py() or "") for t in batch["text"]]) if len(batch) else np.zeros(0)
            while lo < len(batch):
                before = lengths[lo - 1] if lo else 0
                hi = max(int(np.searchsorted(lengths, before + 6 * most_words, "right")), lo + 1)
                part = batch.slice(lo, hi - lo)
                lo = hi
                texts = part["text"].to_pylist()
                if n_langs:
                    row, start, end, lab, letters = label(texts, model, penalty)
                else:
                    row = start = end = lab = letters = np.zeros(0, np.int64)
                by = np.bincount(row * max(n_langs, 1) + lab, letters, len(texts) * max(n_langs, 1)).reshape(len(texts), -1)
                total, best = by.sum(1), by.argmax(1)
                known = total > 0
                names = np.array([*model.langs, UNKNOWN], object)[np.where(known, best, n_langs)]
                share = np.where(known, by.max(1) / np.maximum(total, 1), 0.0)
                columns = [part["doc_id"], part["held_out"], pa.array(names, pa.string()), pa.array(share, pa.float64())]
                if with_spans:
                    columns.append(_spans(row, start, end, lab, model.langs, len(texts)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "spans"][: len(columns)])

    return run


def held_out(doc_id: Column, mod: int = 3, rest: int = 1) -> Column:
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def predict(docs: DataFrame, model: Model, penalty: float = 12.0, with_spans: bool = True) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, and ``spans`` (characters from, to, language).

    ``docs`` has ``doc_id, text, held_out``. The prediction depends on the text alone. ``score`` is the
    share of letters in spans of the predicted language; ties go to the first language by
    code point. Null text, text without a letter, and an empty model give ``und`` and 0.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, held_out boolean, lang_pred string, score double" + (", spans array<struct<start:long,end:long,lang:string>>" if with_spans else "")
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predictor(model, penalty, with_spans), schema)


def language_report(docs: DataFrame, penalty: float = 12.0, with_spans: bool = False) -> DataFrame:
    """Learns from rows that are not held out and have a language, then predicts every row.
    Repeated rows count as often as they occur."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, fit(rows.where("NOT held_out")), penalty, with_spans)
