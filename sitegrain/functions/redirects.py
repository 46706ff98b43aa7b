"""In-page redirects as column expressions, in the order they are tried."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.constants import BODY_SCRIPT_MAX_CHARS, HEAD_SCRIPT_MAX_CHARS
from sitegrain.functions.text import strip
from sitegrain.functions.urls import blank_to_null, join_url, let, or_else, split_url

# The redirect patterns. Each captures the quoted target, so that an
# empty target differs from no match.
HEAD = r"(?is)<head(.*?)</head>"
BODY = r"(?is)<body(.*?)</body>"
SCRIPT = r"(?is)<script>(.*?)</script>"
META = r"""(?is)<meta[^>]*?url=(.*?)["']"""
ONLOAD = r"(?is)window.onload(.*?)}"
SCRIPT_CALLS = [
    r'(?is)top.location.href=(".*?")',
    r'(?is)window.location.href=(".*?")',
    r'(?is)window.navigate\((".*?")\)',
    r'(?is)self.location.href=(".*?")',
]
LOCATION = r'(?is)location=(".*?")'
ANY_MARKER = r"(?i)url=|location|navigate"


def _quoted(text: Column, *patterns: str) -> Column:
    """Target of the first pattern that matches at all; null without a match."""

    def search(t: Column) -> Column:
        found = F.coalesce(*[blank_to_null(F.regexp_extract(t, p, 1)) for p in patterns])
        return let(found, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))

    return let(text, search)


def _block(html: Column, pattern: str, start: str, end: str, max_chars: int) -> Column:
    """Text of the first matching block if it is short enough, null if it is not, and
    the whole page where there is no such block."""

    def inside(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(start) + 1), F.length(block) - len(start) - len(end))
        text = strip(F.replace(inner, F.lit("\r\n"), F.lit("")))
        return F.when(block == "", html).otherwise(let(text, lambda t: F.when(F.length(t) <= max_chars, t)))

    return let(F.regexp_extract(html, pattern, 0), inside)


@lru_cache
def redirect_candidates(html_column: str, url_column: str) -> Column:
    """Array of ``(kind, target)`` in the order they are tried, self-targets left out;
    never null. Most pages fail the first, cheap test and skip the rest."""
    html, url = F.col(html_column), F.col(url_column)

    def trails(head: Column) -> Column:
        tried = [
            ("meta", F.regexp_extract(head, META, 1)),
            ("onload", _quoted(F.regexp_extract(head, ONLOAD, 1), *SCRIPT_CALLS)),
            (
                "body_script",
                _quoted(_block(html, BODY, "<body", "</body>", BODY_SCRIPT_MAX_CHARS), *SCRIPT_CALLS),
            ),
            ("script", _quoted(_block(html, SCRIPT, "<script>", "</script>", HEAD_SCRIPT_MAX_CHARS), LOCATION)),
        ]
        return F.array(
            *[F.struct(F.lit(k).alias("kind"), or_else(strip(t), F.lit(None)).alias("trail")) for k, t in tried]
        )

    found = let(F.regexp_extract(html, HEAD, 1), trails)

    def resolve(parts: Column) -> Column:
        return F.transform(
            F.filter(found, lambda c: c["trail"].isNotNull()),
            lambda c: F.struct(c["kind"].alias("kind"), join_url(url, parts, c["trail"]).alias("target")),
        )

    targets = F.filter(let(split_url(url, F.lit("")), resolve), lambda c: c["target"] != url)
    return F.when(html.rlike(ANY_MARKER), targets).otherwise(
        F.array().cast("array<struct<kind:string,target:string>>")
    )
