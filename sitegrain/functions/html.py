"""Link attributes and address-like words of a page, as column expressions.

One regular expression walks the markup once. It steps over comments, scripts and
styles, and captures ``href`` of ``a`` and ``src`` of ``frame``/``iframe``. All
repeats are possessive, so the time is linear in the page length and the matcher
needs no deep stack.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.text import strip
from sitegrain.functions.urls import let

_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_ATTR = rf"[^\s=>/]++{_VALUE}"


def _up_to(name: str) -> str:
    """Attributes before ``name``, stopping right in front of it."""
    here = rf"{name}(?=[\s=>/]|\z)"
    return rf"(?:[\s/]++|=|(?!{here}){_ATTR})*+(?={here})"


# The first letter is tested before the alternatives: most tags are none of these.
LINK_ATTRIBUTES = (
    r"(?s)<(?=[!aAfFiIsS])(?i:!--.*?(?:-->|\z)"
    r"|script(?=[\s/>]).*?(?:</script|\z)|style(?=[\s/>]).*?(?:</style|\z)"
    rf"|(?:a(?=[\s/]){_up_to('href')}|i?frame(?=[\s/]){_up_to('src')})({_ATTR}))"
)

# Fixed value: the address pattern. It starts at the beginning of a word, so that a long
# dotless word is read once; a scheme is recognised by looking back from its colon. A
# word with letters glued in front of the scheme is therefore found too long, and
# ``addresses`` cuts the letters off.
_WORD = r"[\p{L}\p{N}_\-]"
_SCHEME = r"(?:ht|f)tps?"
_TAIL = r"(?:[\p{L}\p{N}_\-.,@?^=%&:/~+#]*[\p{L}\p{N}_\-@?^=%&/~+#])?"
ADDRESS = rf"(?<!{_WORD}){_WORD}++(?=[.:])(?:(?=:)(?<={_SCHEME})://{_WORD}++)?\.{_WORD}+{_TAIL}"
_GLUED = rf"^{_WORD}+?(?={_SCHEME}://{_WORD})"


def _code_point(n: Column) -> Column:
    """Character of a code point; empty where no character is allowed."""
    allowed = (
        n.isin(9, 10, 13)
        | n.between(0x20, 0xD7FF)
        | n.between(0xE000, 0xFFFD)
        | n.between(0x10000, 0x10FFFF)
    )
    return F.when(
        allowed, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    ).otherwise("")


def unescape(value: Column) -> Column:
    """Character references replaced: numeric ones, and HTML 4 names ending in ``;``."""
    names = F.from_json(
        F.lit(json.dumps({k: chr(v) for k, v in name2codepoint.items()})), "map<string,string>"
    )

    def piece(p: Column) -> Column:
        decimal = F.regexp_extract(p, r"^#([0-9]+)", 1)
        hexadecimal = F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]+)", 1)
        named = names[F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)]
        return (
            F.when(
                decimal != "",
                F.concat(
                    _code_point(F.coalesce(decimal.try_cast("bigint"), F.lit(0))),
                    F.regexp_replace(p, r"^#[0-9]+;?", ""),
                ),
            )
            .when(
                hexadecimal != "",
                F.concat(
                    _code_point(F.coalesce(F.conv(hexadecimal, 16, 10).try_cast("bigint"), F.lit(0))),
                    F.regexp_replace(p, r"^#[xX][0-9a-fA-F]+;?", ""),
                ),
            )
            .when(named.isNotNull(), F.concat(named, F.regexp_replace(p, r"^[A-Za-z0-9]+;", "")))
            .otherwise(F.concat(F.lit("&"), p))
        )

    def whole(parts: Column) -> Column:
        return F.concat(
            parts.getItem(0),
            F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""),
        )

    return F.when(value.contains("&"), let(F.split(value, "&"), whole)).otherwise(value)


def link_attributes(html: Column) -> Column:
    """Array of ``(kind, link)``: kind ``a`` or ``frame``, link unescaped and unquoted."""
    found = F.filter(F.regexp_extract_all(html, F.lit(LINK_ATTRIBUTES), F.lit(1)), lambda t: t != "")

    def one(token: Column) -> Column:
        quoted = F.regexp_replace(token, r"^[^\s=]+\s*=?\s*", "")
        bare = F.when(
            quoted.startswith('"') | quoted.startswith("'"),
            F.substring(quoted, F.lit(2), F.length(quoted) - 2),
        ).otherwise(quoted)
        return F.struct(
            F.when(F.lower(F.substring(token, 1, 4)) == "href", "a").otherwise("frame").alias("kind"),
            unescape(bare).alias("link"),
        )

    return F.transform(found, one)


def keep_anchor(link: Column) -> Column:
    return ~(link.isin("/", "*") | link.startswith("javascript") | link.startswith("mailto"))


def keep_frame(link: Column) -> Column:
    return ~(strip(link).isin("", "about:blank") | link.contains("*"))


@lru_cache
def anchors(html: str) -> Column:
    """Anchor links of a page, in page order."""
    kept = F.filter(link_attributes(F.col(html)), lambda e: (e["kind"] == "a") & keep_anchor(e["link"]))
    return kept["link"]


@lru_cache
def frames(html: str) -> Column:
    """Frame sources of a page, in page order."""
    kept = F.filter(link_attributes(F.col(html)), lambda e: (e["kind"] == "frame") & keep_frame(e["link"]))
    return kept["link"]


@lru_cache
def markup_links(html: str) -> Column:
    """Anchor links and frame sources from a single walk over the markup."""
    kept = F.filter(
        link_attributes(F.col(html)),
        lambda e: F.when(e["kind"] == "a", keep_anchor(e["link"])).otherwise(keep_frame(e["link"])),
    )
    return kept["link"]


def addresses(text: str) -> Column:
    """Every address-like word of a text (``a.b``, ``http://a.b/c``, ``1.2.3.4`` …)."""
    found = F.regexp_extract_all(F.col(text), F.lit(ADDRESS), F.lit(0))
    return F.transform(
        found, lambda a: F.when(a.contains("://"), F.regexp_replace(a, _GLUED, "")).otherwise(a)
    )
