"""Decoding, content fingerprints, and dropping blank or placeholder pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.constants import USELESS_MAX_CHARS, USELESS_PHRASES
from sitegrain.functions.charsets import likeliest_charset

_BOMS = (
    (b"\xff\xfe\x00\x00", "utf-32"),
    (b"\x00\x00\xfe\xff", "utf-32"),
    (b"\xff\xfe", "utf-16"),
    (b"\xfe\xff", "utf-16"),
)


def _quoted(phrases: Sequence[str]) -> str:
    return "|".join(r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" for p in phrases)


def is_useless(
    text: Column,
    phrases: Sequence[str] = USELESS_PHRASES,
    max_chars: int = USELESS_MAX_CHARS,
) -> Column:
    """A listed phrase occurs and the text is shorter than ``max_chars``. The length is
    tested first, so that long pages are never searched."""
    phrases = [p for p in dict.fromkeys(phrases) if p]
    if not phrases:
        return F.lit(False)
    return F.coalesce(
        F.when(F.length(text) < max_chars, text.rlike(_quoted(phrases))).otherwise(False), F.lit(False)
    )


def drop_useless_pages(
    pages: DataFrame,
    text: str = "html",
    phrases: Sequence[str] = USELESS_PHRASES,
    max_chars: int = USELESS_MAX_CHARS,
) -> DataFrame:
    return pages.filter(~is_useless(F.col(text), phrases, max_chars))


def is_blank(body: Column) -> Column:
    return F.coalesce(F.length(body), F.lit(0)) == 0


def drop_blank_pages(pages: DataFrame, body: str = "html") -> DataFrame:
    return pages.filter(~is_blank(F.col(body)))


def _decode_one(raw: bytes) -> str:
    """Decode bytes that are not valid UTF-8; empty when the guess does not hold."""
    guess = next((name for bom, name in _BOMS if raw.startswith(bom)), None) or likeliest_charset(raw)
    try:
        return raw.decode(guess)
    except UnicodeError:
        return ""


@F.pandas_udf(T.StringType())
def _decode_guessed(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else _decode_one(bytes(b)))


def decode_pages(pages: DataFrame, content: str = "content", out: str = "page_text") -> DataFrame:
    """Adds the page text.

    Valid UTF-8 is decoded by Spark. Only the other bytes are handed to Python, in
    Arrow batches: the rest of the column reaches it as nulls. A byte-order mark names
    the charset, else byte and pair statistics do (``functions/charsets.py``). Bytes that
    the likeliest charset does not hold throughout, and null content, give ''.
    """
    raw = F.coalesce(F.col(content), F.lit(b""))
    as_text = raw.cast("string")
    valid = F.is_valid_utf8(as_text)
    unmarked = F.regexp_replace(as_text, r"^\x{FEFF}", "")
    return pages.withColumn(
        out,
        F.coalesce(
            F.when(valid, unmarked),
            _decode_guessed(F.when(~valid, raw)),
            F.lit(""),
        ),
    )


def dedup_by_content(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of exact copies: ``md5, kept, n`` with the smallest key kept."""
    return (
        df.select(F.md5(F.col(text)).alias("md5"), key)
        .groupBy("md5")
        .agg(F.min(key).alias("kept"), F.count("*").alias("n"))
    )


def apply_hook(pages: DataFrame, hook: Callable[[Column], Column] | None, text: str = "page_text") -> DataFrame:
    """Kept page text passed through a content hook; identity without one."""
    return pages if hook is None else pages.withColumn(text, hook(F.col(text)))
