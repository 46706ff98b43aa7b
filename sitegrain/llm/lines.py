"""Line de-duplication across documents.

Lines are exploded as (document, position, hash of the normalised line), distinct
documents are counted per hash, lines over the threshold go from every document but
the first, and what stays is put together by position. Text is never shuffled for the
counting: only hashes and positions are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import SPACES, let, lower_ascii, text_key
from sitegrain.plans.staging import Staging


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _hash_if_long(line: Column, min_chars: int) -> Column:
    return let(line_key(line), lambda k: F.when(F.length(k) >= min_chars, text_key(k)))


def repeated_lines(docs: DataFrame, stage: Staging, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Positions to drop: ``_id, _key, _drops`` (distinct, ascending). ``_key`` stands for the
    text, so rows that repeat a ``doc_id`` with another text have their own positions."""
    lines = stage.write(
        docs.select(
            F.col("doc_id").alias("_id"),
            text_key("text").alias("_key"),
            F.posexplode(F.transform(split_lines(F.col("text")), lambda l: _hash_if_long(l, min_chars))).alias("_pos", "_line"),
        ).where("_line IS NOT NULL"),
        "lines",
    )
    # Written, so that the join below may deal a very common line out to several tasks.
    repeated = stage.write(
        lines.select("_line", "_id")
        .distinct()
        .groupBy("_line")
        .agg(F.count(F.lit(1)).alias("_docs"), F.min("_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
        .drop("_docs"),
        "repeated",
    )
    return (
        lines.join(repeated, "_line")
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_key")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_drops"))
    )


def drop_repeated_lines(docs: DataFrame, stage: Staging, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text`` cut down, plus ``_n_lines`` and ``_n_dropped`` (long).

    A key is the line without white space at its ends and with A-Z lower-cased. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines
    but those of the document with the smallest ``doc_id``.

    Null or empty text is one empty line, and a null text stays null. Rows with one
    ``doc_id`` are one document; all rows with a null ``doc_id`` are one too, and are
    never the first when another document has the line. Repeats inside the first document
    stay. Other columns pass through whatever their names; names that begin with an
    underscore and one of this module's words (``_id``, ``_key``, ``_drops``) are reserved.
    """
    drops = repeated_lines(docs, stage, min_chars, min_docs)
    joined = docs.withColumn("_text_key", text_key("text")).join(
        drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left"
    )
    n_lines = F.size(split_lines(F.col("text")))

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drops"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    cut = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(let(split_lines(F.col("text")), kept))
    return joined.select(
        *[F.col(f"`{c}`") if c != "text" else cut.alias("text") for c in docs.columns],
        n_lines.cast("long").alias("_n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("_n_dropped"),
    )


def line_report(docs: DataFrame, stage: Staging, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Per row ``doc_id, n_lines, n_dropped, kept_sha256``."""
    return drop_repeated_lines(docs.select("doc_id", "text"), stage, min_chars, min_docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
