"""Seed lists, fetch logs and raw page files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.functions.text import escaped_name
from sitegrain.operators.store import put_contents


def is_seed(line: Column) -> Column:
    return line.rlike(r"^[^\n]+\.[^\n]")


def valid_seeds(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that look like ``x.y``, without line ends; spaces stay."""
    url = F.btrim(F.btrim(F.col(value), F.lit("\n")), F.lit("\r"))
    return lines.select(url.alias("url")).filter(is_seed(F.col("url")))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs of a text file, one per line."""
    return valid_seeds(spark.read.text(path))


def split_seed_lists(lists: DataFrame, value: str = "value") -> DataFrame:
    """Comma-separated URLs, one row each; spaces removed, nothing validated."""
    return lists.select(
        F.explode(F.split(F.replace(F.col(value), F.lit(" "), F.lit("")), ",")).alias("url")
    )


def seeds_from_list(spark: SparkSession, csv: str) -> DataFrame:
    return split_seed_lists(spark.createDataFrame([(csv,)], "value string"))


def parse_fetch_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """``outcome, url`` of lines ``Success: url`` and ``Failed: url``; others are left out."""
    line = F.col(value)
    return lines.select(
        F.regexp_extract(line, r"^(Success|Failed): ", 1).alias("outcome"),
        F.regexp_replace(line, r"^(Success|Failed): ", "").alias("url"),
    ).filter(F.col("outcome") != "")


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_fetch_log(spark.read.text(path))


def read_raw_pages(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Content rows of the files under a folder; the file path is the file name."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return put_contents(files, "path", "content", upload_date=F.col("modificationTime"))


def write_raw_pages(pages: DataFrame, path: str, name: str, body: str) -> int:
    """One file per row under a folder that all tasks reach, written by the tasks; how many.

    Files are dealt over 256 folders by name. Names are escaped as those of saved pages, so none leads
    out of its folder; a null or empty one, ``.`` and ``..`` raise before anything is written. A row whose escaped name another
    has replaces its file, so a task that runs again leaves the same files. A null body is an empty file.
    ``path`` is of a file system that ``pyarrow.fs`` opens.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for file, content in zip(batch["name"].to_pylist(), batch["body"].to_pylist(), strict=True):
                folder = f"{base}/{zlib.crc32(file.encode()) % 256:02x}"
                if folder not in made:
                    fs.create_dir(folder)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/{file}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    content = F.col(body) if isinstance(pages.schema[body].dataType, T.BinaryType) else F.encode(body, "UTF-8")
    escaped = escaped_name(F.col(name).cast("string"))
    if not pages.filter(escaped.isNull() | escaped.isin("", ".", "..")).isEmpty():
        raise ValueError("a page has no file name")
    rows = pages.select(escaped.alias("name"), F.coalesce(content, F.lit(b"")).alias("body"))
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
