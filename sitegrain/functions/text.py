"""Small text rules: stripping, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.constants import FILE_NAME_MAX_CHARS

WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Unicode white space removed at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def escaped_name(url: Column) -> Column:
    """URL with ``/ : * ?`` replaced by ``{ } [ ^``."""
    return F.translate(url, "/:*?", "{}[^")


def base64_name(url: Column, url_safe: bool = False) -> Column:
    """Base64 of the URL on one line; plain base64 may hold ``/``."""
    name = F.regexp_replace(F.base64(F.encode(url, "UTF-8")), "[\r\n]", "")
    return F.translate(name, "+/", "-_") if url_safe else name


def file_name(url: Column, naming: str = "escaped") -> Column:
    """Name of a saved page; md5 of the name where it is over 255 characters."""
    if naming not in ("escaped", "base64", "base64url"):
        raise ValueError(f"unknown naming {naming!r}")
    name = escaped_name(url) if naming == "escaped" else base64_name(url, naming == "base64url")
    return F.when(F.length(name) > FILE_NAME_MAX_CHARS, F.md5(name)).otherwise(name)
