"""URL rules as built-in column expressions.

Everything here is JVM-side: no Python worker is started. ``let`` binds a
computed value to a lambda variable, so that an expression used several times is
written into the plan only once.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import uses_netloc, uses_params, uses_relative

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.constants import NON_PAGE_EXTENSIONS, PAGE_EXTENSIONS, TWO_LABEL_SUFFIXES

_OCTET = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def blank_to_null(c: Column) -> Column:
    """For short expressions: Spark writes the argument out twice."""
    return F.nullif(c, F.lit(""))


def or_else(c: Column, fallback: Column) -> Column:
    """``c`` unless it is blank; for long expressions, which are evaluated once."""
    return let(c, lambda v: F.when(v != "", v).otherwise(fallback))


# --- parts, key, host, site domain ------------------------------------------------


def _after_scheme(u: Column) -> Column:
    """The text behind ``scheme:``, or everything when there is no scheme."""
    return F.regexp_replace(u, r"^[^/:]+:", "")


def _drop_port(host: Column) -> Column:
    return F.regexp_replace(host, r":[0-9]*\z", "")


def url_parts(u: Column) -> Column:
    """Struct ``protocol, host, port, rest``; null when the URL has no authority."""
    protocol = blank_to_null(F.lower(F.regexp_extract(u, r"^([^/:]+):", 1)))
    slashed = F.when(protocol.isNull(), F.concat(F.lit("//"), u)).otherwise(_after_scheme(u))

    def from_slashed(s: Column) -> Column:
        authority = F.regexp_extract(s["rest"], r"^//([^/#?]*)", 1)
        path = F.regexp_replace(s["rest"], r"^//[^/#?]*", "")
        protocol = F.coalesce(s["protocol"], F.lit("http"))
        return F.when(
            s["rest"].startswith("//"),
            F.struct(
                protocol.alias("protocol"),
                _drop_port(authority).alias("host"),
                F.coalesce(
                    blank_to_null(F.regexp_extract(authority, r":([0-9]+)\z", 1)),
                    F.when(protocol == "https", "443").otherwise("80"),
                ).alias("port"),
                F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path))
                .otherwise(path)
                .alias("rest"),
            ),
        )

    return F.when(u != "", let(F.struct(protocol.alias("protocol"), slashed.alias("rest")), from_slashed))


def url_key(u: Column, with_rest: bool = True) -> Column:
    """Canonical ``proto://host:port/rest/``; null when the URL is invalid."""

    def from_parts(p: Column) -> Column:
        root = F.concat(p["protocol"], F.lit("://"), p["host"], F.lit(":"), p["port"], F.lit("/"))
        if not with_rest:
            return F.when(p["host"] != "", root)
        rest = F.btrim(p["rest"], F.lit("/"))
        return F.when(
            p["host"] != "",
            F.when(rest != "", F.concat(root, rest, F.lit("/"))).otherwise(root),
        )

    return let(url_parts(u), from_parts)


def host_of(u: Column) -> Column:
    """Host without port. Text without an authority is its own host."""
    authority = blank_to_null(F.regexp_extract(u, r"^(?:[^/:]+:)?//([^/#?]+)", 1))
    rest = _after_scheme(u)
    path = F.substring(rest, 3, 2147483647)
    no_authority = (
        F.when(~rest.startswith("//"), rest)
        .when((path == "") | path.startswith("/"), path)
        .otherwise(F.concat(F.lit("/"), path))
    )
    return _drop_port(F.coalesce(authority, no_authority))


def is_ip(host: Column) -> Column:
    return host.rlike(rf"^({_OCTET}\.){{3}}{_OCTET}\n?\z")


def site_domain(host: Column) -> Column:
    """Registrable domain: the last two labels, or three behind a listed suffix."""
    last_two = F.substring_index(host, ".", -2)
    return (
        F.when(is_ip(host), host)
        .when(F.concat(F.lit("."), last_two).isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3))
        .otherwise(last_two)
    )


def is_http_url(u: Column) -> Column:
    return u.rlike(r"^https?:(//|\\\\)") & ~u.isin("http://", "https://")


def is_page_link(link: Column) -> Column:
    """False for links to listed file types; ``…download/app`` always passes."""
    return link.endswith("download/app") | ~F.substring_index(link, ".", -1).isin(NON_PAGE_EXTENSIONS)


# --- joining and completing links ----------------------------------------------------


def split_url(u: Column, default_scheme: Column) -> Column:
    """RFC 3986 parts: ``scheme, netloc, path, params, query, fragment``."""

    def scheme_step(s: Column) -> Column:
        scheme = F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
        return F.struct(
            F.when(scheme == "", default_scheme).otherwise(F.lower(scheme)).alias("scheme"),
            F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "").alias("rest"),
        )

    def netloc_step(s: Column) -> Column:
        tail = F.regexp_replace(s["rest"], r"^//[^/?#]*", "")
        return F.struct(
            s["scheme"].alias("scheme"),
            F.regexp_extract(s["rest"], r"^//([^/?#]*)", 1).alias("netloc"),
            F.regexp_extract(tail, r"^([^?#]*)", 1).alias("path"),
            F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(tail, r"(?s)^[^#]*#(.*)", 1).alias("fragment"),
        )

    def params_step(s: Column) -> Column:
        split = s["scheme"].isin(uses_params) & s["path"].contains(";")
        return F.struct(
            s["scheme"].alias("scheme"),
            s["netloc"].alias("netloc"),
            F.when(split, F.regexp_replace(s["path"], r";[^/]*\z", "")).otherwise(s["path"]).alias("path"),
            F.when(split, F.regexp_extract(s["path"], r";([^/]*)\z", 1)).otherwise("").alias("params"),
            s["query"].alias("query"),
            s["fragment"].alias("fragment"),
        )

    clean = F.regexp_replace(u, r"^[\x00-\x20]+|[\t\r\n]", "")
    return let(let(let(clean, scheme_step), netloc_step), params_step)


def _unsplit(p: Column) -> Column:
    """URL text of its parts."""
    scheme, netloc = p["scheme"], p["netloc"]
    path = F.when(p["params"] != "", F.concat(p["path"], F.lit(";"), p["params"])).otherwise(p["path"])
    slashes = (netloc != "") | path.startswith("//") | (
        (scheme != "") & scheme.isin(uses_netloc) & ((path == "") | path.startswith("/"))
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(slashes, F.concat(F.lit("//"), netloc)).otherwise(""),
        F.when((netloc != "") & (path != "") & ~path.startswith("/"), "/").otherwise(""),
        path,
        F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""),
        F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""),
    )


def _merge_path(base_path: Column, path: Column) -> Column:
    """Path of a reference against its base path, dot segments removed."""
    base_parts = F.split(base_path, "/")
    kept = F.when(
        F.substring_index(base_path, "/", -1) != "", F.slice(base_parts, 1, F.size(base_parts) - 1)
    ).otherwise(base_parts)
    joined = F.concat(kept, F.split(path, "/"))
    relative = let(
        joined,
        lambda a: F.filter(a, lambda seg, i: (seg != "") | (i == 0) | (i == F.size(a) - 1)),
    )
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)

    def fold(segs: Column) -> Column:
        resolved = F.aggregate(
            segs,
            F.array().cast("array<string>"),
            lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg))),
        )
        ends_open = F.element_at(segs, -1).isin(".", "..")
        closed = F.concat(resolved, F.when(ends_open, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
        return or_else(F.array_join(closed, "/"), F.lit("/"))

    return let(segments, fold)


def join_url(base: Column, base_parts: Column, url: Column) -> Column:
    """Standard URL join. ``base_parts`` is ``split_url(base, '')``, so that a page's
    base is split once and not once per link."""

    def chosen(r: Column) -> Column:
        """Each part from the reference or, where that is silent, from the base."""
        absolute = r["netloc"] != ""
        stays = ~absolute & (r["path"] == "") & (r["params"] == "")
        return F.struct(
            ((r["scheme"] == base_parts["scheme"]) & r["scheme"].isin(uses_relative)).alias("joins"),
            (r["netloc"].contains("[") != r["netloc"].contains("]")).alias("broken"),
            r["scheme"].alias("scheme"),
            F.when(absolute, r["netloc"]).otherwise(base_parts["netloc"]).alias("netloc"),
            F.when(absolute, r["path"])
            .when(stays, base_parts["path"])
            .otherwise(_merge_path(base_parts["path"], r["path"]))
            .alias("path"),
            F.when(stays, base_parts["params"]).otherwise(r["params"]).alias("params"),
            F.when(stays & (r["query"] == ""), base_parts["query"]).otherwise(r["query"]).alias("query"),
            r["fragment"].alias("fragment"),
        )

    def joined(p: Column) -> Column:
        return F.when(~p["joins"] | p["broken"], url).otherwise(_unsplit(p))

    return (
        F.when(base.isNull() | (base == ""), url)
        .when(url == "", base)
        .otherwise(let(let(split_url(url, base_parts["scheme"]), chosen), joined))
    )


def page_base(u: Column, keep_port: bool = False) -> Column:
    """What a page contributes to completing its links, as one struct column.

    ``root`` is ``proto://host`` with the port left out unless ``keep_port``; it is
    null for a page URL without a scheme. ``plain`` says that a rooted link can
    simply be appended to ``root``.
    """
    scheme = F.lower(F.regexp_extract(u, r"^([^/:]+):", 1))
    host = host_of(u)
    if keep_port:
        located = F.coalesce(
            blank_to_null(F.regexp_extract(u, r"^(?:[^/:]+:)?//([^/#?]+)", 1)), host
        )
    else:
        located = host
    root = F.when(scheme != "", F.concat(scheme, F.lit("://"), located))
    return let(
        F.struct(u.alias("url"), scheme.alias("scheme"), host.alias("host"), root.alias("root")),
        lambda p: F.struct(
            p["url"].alias("url"),
            p["host"].alias("host"),
            site_domain(p["host"]).alias("domain"),
            p["root"].alias("root"),
            F.concat(p["scheme"], F.lit("://"), p["host"], F.lit("/")).alias("home"),
            (p["scheme"].isin(uses_relative) & p["host"].rlike(r"^[^/?#;\[\]\s:]+\z")).alias("plain"),
            split_url(p["root"], F.lit("")).alias("root_parts"),
            split_url(p["url"], F.lit("")).alias("url_parts"),
        ),
    )


def complete_link(page: Column, link: Column, strict_resolve: bool = False) -> Column:
    """Absolute form of a link found on a page; ``page`` is ``page_base(url)``.

    Links starting with ``/`` or ``.`` lose trailing dots and hang off the site
    root. Links that do not look like ``x.y``, or are a single file name with a
    page extension, are joined to the page URL. Others stay as they are, unless
    ``strict_resolve`` asks for a standard join of every link.
    """
    if strict_resolve:
        return join_url(page["url"], page["url_parts"], link)
    rooted = link.startswith("/") | link.startswith(".")
    to_page = ~link.rlike(r"^[^\n]+\.[^\n]") | (
        (F.length(link) - F.length(F.replace(link, F.lit("."))) <= 1)
        & F.substring_index(link, ".", -1).isin(PAGE_EXTENSIONS)
    )

    def complete(c: Column) -> Column:
        simple = (
            c["rooted"]
            & page["plain"]
            & c["link"].startswith("/")
            & ~c["link"].rlike(r"^//|/\.\.?(?:/|\z)|[;?#\x00-\x20]")
        )
        base = F.when(c["rooted"], page["root"]).otherwise(page["url"])
        base_parts = F.when(c["rooted"], page["root_parts"]).otherwise(page["url_parts"])
        joined = let(
            F.struct(base.alias("base"), base_parts.alias("parts")),
            lambda b: join_url(b["base"], b["parts"], c["link"]),
        )
        return (
            F.when(simple, F.concat(page["root"], c["link"]))
            .when(c["joins"], or_else(joined, c["link"]))
            .otherwise(c["link"])
        )

    return let(
        F.struct(
            rooted.alias("rooted"),
            (rooted | to_page).alias("joins"),
            F.when(rooted & link.endswith("."), F.regexp_replace(link, r"\.+\z", "")).otherwise(link).alias("link"),
        ),
        complete,
    )


def link_scope(page: Column, link: Column) -> Column:
    """Narrowest crawl level a completed link belongs to: 0 host, 1 domain, 2 any.

    Most links start with the page's own root, which settles them without a parse.
    """
    return F.when(page["plain"] & link.startswith(page["home"]), 0).otherwise(
        let(
            host_of(link),
            lambda h: F.when(h == page["host"], 0).when(site_domain(h) == page["domain"], 1).otherwise(2),
        )
    )
