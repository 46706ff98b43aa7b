"""Phrase search: every phrase, every occurrence, overlaps included.

Each phrase has one anchor: its longest whole word, where a word counts as whole if other characters of the
phrase stand on both its sides, else two characters of the phrase, or the only one it has. A text
that holds the phrase holds the anchor, as a word or as neighbouring characters. Texts and phrases meet by
their anchors, as narrow rows; occurrences are counted only where they have met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.plans.staging import Staging

_LETTER = r"\p{L}\p{N}_"
_WORD = f"[{_LETTER}]+"
_WHOLE_WORD = f"(?<=[^{_LETTER}])[{_LETTER}]+(?=[^{_LETTER}])"


def _characters(text: Column) -> Column:
    return F.split(text, "")


def _pairs(text: Column) -> Column:
    """Neighbouring characters, two by two; the character of a text that has one."""
    chars = _characters(text)
    two = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, b)))
    return F.filter(two, lambda p: p.isNotNull())


def _anchors(phrases: DataFrame) -> DataFrame:
    """``pattern, kind, anchor``."""
    words = F.regexp_extract_all("pattern", F.lit(_WHOLE_WORD), 0)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    # The first pair whose characters differ, as it is rarer than others; any pair would do.
    pairs = _pairs(F.col("pattern"))
    pair = F.coalesce(F.get(F.filter(pairs, lambda p: F.left(p, F.lit(1)) != F.right(p, F.lit(1))), F.lit(0)), F.get(pairs, F.lit(0)))
    return phrases.withColumn("_w", longest).select(
        "pattern",
        F.when(F.col("_w").isNotNull(), "word").when(F.length("pattern") > 1, "pair").otherwise("one").alias("kind"),
        F.coalesce("_w", F.when(F.length("pattern") > 1, pair), "pattern").alias("anchor"),
    )


def _named(kind: str, anchors: Column) -> Column:
    return F.transform(anchors, lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("anchor")))


def _hits(text: Column, pattern: Column) -> Column:
    """Occurrences of a phrase, overlapping ones too."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.regexp_count(text, quoted).cast("bigint")


def match_patterns(df: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str = "pattern") -> DataFrame:
    """``(key, pattern, hits)`` for each phrase that occurs in a text.

    Texts are split into anchors in one pass, whatever the number of phrases, and stay where they are unless
    a phrase may occur in them. Phrase rows that repeat count once, empty and null ones not at all. Rows
    of ``df`` that repeat a key are searched each; null texts hold nothing.
    """
    stage = Staging(df.sparkSession, "phrases")
    phrases = patterns.select(F.col(pattern).alias("pattern")).filter(F.length("pattern") > 0).distinct()
    anchors = stage.write(_anchors(phrases), "anchors")
    kinds = {r[0] for r in anchors.select("kind").distinct().collect()}  # three at most
    body = F.col(text)
    forms = {"word": F.regexp_extract_all(body, F.lit(_WORD), 0), "pair": _pairs(body), "one": _characters(body)}
    # A text is known by its hash beside its key, which rows may share.
    which = [F.col(key).alias("_key"), F.xxhash64(body).alias("_h1"), F.xxhash64(F.lit(1), body).alias("_h2")]
    used = [_named(k, F.array_distinct(forms[k])) for k in sorted(kinds)]
    if not used:
        return df.select(key, F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("bigint").alias("hits")).limit(0)
    held = df.filter(body.isNotNull()).select(*which, F.explode(F.concat(*used)).alias("a")).select("_key", "_h1", "_h2", "a.kind", "a.anchor")
    met = stage.write(held.join(anchors, ["kind", "anchor"]).select("_key", "_h1", "_h2", "pattern").distinct(), "met")
    same = F.col("_key").eqNullSafe(F.col(key)) & (F.col("_h1") == F.xxhash64(body)) & (F.col("_h2") == F.xxhash64(F.lit(1), body))
    found = df.select(key, text).join(met, same).filter(F.contains(body, F.col("pattern")))
    return found.select(key, "pattern", _hits(body, F.col("pattern")).alias("hits"))
