"""URL rules: golden rows, and random URLs against plain Python."""

import random
import re
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegrain.constants import PAGE_EXTENSIONS, TWO_LABEL_SUFFIXES
from sitegrain.functions import urls as U
from sitegrain.operators import links, urls

GOLDEN = [
    ("http://www.a.com", "http://www.a.com:80/", "www.a.com", "a.com"),
    ("HTTP://www.A.com/x/", "http://www.A.com:80/x/", "www.A.com", "A.com"),
    ("https://a.com/x?b=1", "https://a.com:443/x?b=1/", "a.com", "a.com"),
    ("https://a.com:8443/x#top", "https://a.com:8443/x#top/", "a.com", "a.com"),
    ("a.com/x", "http://a.com:80/x/", "a.com/x", "a.com/x"),
    ("http://a.com?q=1", "http://a.com:80/?q=1/", "a.com", "a.com"),
    ("http://a.com:/x", "http://a.com:80/x/", "a.com", "a.com"),
    ("localhost:8080/x", None, "8080/x", "8080/x"),
    ("mailto:x@y.z", None, "x@y.z", "x@y.z"),
    ("", None, "", ""),
    ("http://u:p@a.com/x", "http://u:p@a.com:80/x/", "u:p@a.com", "u:p@a.com"),
    ("http:///x", None, "/x", "/x"),
    ("ftp://a.com/f", "ftp://a.com:80/f/", "a.com", "a.com"),
    ("http://a.com//x//", "http://a.com:80/x/", "a.com", "a.com"),
    ("http://tieba.baidu.com/p", "http://tieba.baidu.com:80/p/", "tieba.baidu.com", "baidu.com"),
    ("http://www.x.com.cn", "http://www.x.com.cn:80/", "www.x.com.cn", "x.com.cn"),
    ("http://x.com.cn", "http://x.com.cn:80/", "x.com.cn", "x.com.cn"),
    ("http://a.b.x.gov.cn:80/", "http://a.b.x.gov.cn:80/", "a.b.x.gov.cn", "x.gov.cn"),
    ("http://10.0.0.1:80/", "http://10.0.0.1:80/", "10.0.0.1", "10.0.0.1"),
    ("http://com.cn", "http://com.cn:80/", "com.cn", "com.cn"),
    ("http://a.b.c.co.uk", "http://a.b.c.co.uk:80/", "a.b.c.co.uk", "co.uk"),
]

PAGE = "http://h.com:8080/p/q.html"
LINKS = [
    ("/a", True, "http://h.com/a", 0),
    ("./a", True, "http://h.com/a", 0),
    ("../a", True, "http://h.com/a", 0),
    ("/a/../b", True, "http://h.com/b", 0),
    ("//cdn.x.com/a", True, "http://cdn.x.com/a", 2),
    ("/et.", True, "http://h.com/et", 0),
    (".", True, "http://h.com", 0),
    ("a", True, "http://h.com:8080/p/a", 0),
    ("a.html", True, "http://h.com:8080/p/a.html", 0),
    ("d/a.html", True, "http://h.com:8080/p/d/a.html", 0),
    ("d/a.b.html", True, "d/a.b.html", 2),
    ("a.html?x=1", True, "a.html?x=1", 2),
    ("a.jpg", False, "a.jpg", 2),
    ("http://o.com/z", True, "http://o.com/z", 2),
    ("http://w.h.com/z", True, "http://w.h.com/z", 1),
    ("www.o.com", True, "www.o.com", 2),
    ("#top", True, "http://h.com:8080/p/q.html#top", 0),
    ("?x=1", True, "http://h.com:8080/p/q.html?x=1", 0),
    ("", True, "http://h.com:8080/p/q.html", 0),
    ("tel:123", True, "tel:123", 2),
    ("http://example.ai", False, "http://example.ai", 2),
    ("http://example.ai/", True, "http://example.ai/", 2),
    ("/css", True, "http://h.com/css", 0),
    ("css", False, "http://h.com:8080/p/css", 0),
    ("download/app", True, "http://h.com:8080/p/download/app", 0),
    ("/x.PNG", True, "http://h.com/x.PNG", 0),
    ("/x.png?v=1", True, "http://h.com/x.png?v=1", 0),
]


def test_golden_urls(spark):
    u = F.col("u")
    rows = spark.createDataFrame([(r[0],) for r in GOLDEN], "u string").select(
        u, U.url_key(u), U.host_of(u), U.site_domain(U.host_of(u))
    )
    assert [tuple(r) for r in rows.collect()] == GOLDEN


def test_golden_links(spark):
    page, link = U.page_base(F.lit(PAGE)), F.col("l")
    rows = (
        spark.createDataFrame([(r[0],) for r in LINKS], "l string")
        .select(link, U.is_page_link(link).alias("kept"), U.complete_link(page, link).alias("c"))
        .select("l", "kept", "c", U.link_scope(page, F.col("c")))
    )
    assert [tuple(r) for r in rows.collect()] == LINKS


def test_link_variants(spark):
    rows = spark.createDataFrame(
        [("h.com/p", "/a"), ("http://h.com:81/p/", "/a"), ("http://h.com/p/", "x/y.z?q")], "url string, link string"
    )
    found = lambda **kw: [r.resolved for r in links.resolve_links(rows, **kw).collect()]
    assert found() == ["/a", "http://h.com/a", "x/y.z?q"]
    assert found(keep_port=True) == ["/a", "http://h.com:81/a", "x/y.z?q"]
    assert found(strict_resolve=True) == ["/a", "http://h.com:81/a", "http://h.com/p/x/y.z?q"]


# --- plain-Python restatements -------------------------------------------------------


def py_split(u):
    m = re.match(r"([^/:]+):(.*)\Z", u, re.S)
    return (m[1].lower(), m[2]) if m else (None, u)


def py_authority(rest):
    m = re.match(r"//([^/#?]*)(.*)\Z", rest, re.S)
    if not m:
        return None, rest
    return m[1], m[2] if not m[2] or m[2][0] == "/" else "/" + m[2]


def py_port(host):
    m = re.fullmatch(r"(.*):([0-9]*)", host, re.S)
    return (m[1], m[2] or None) if m else (host, None)


def py_key(u):
    if not u:
        return None
    scheme, rest = py_split(u)
    if scheme is None:
        scheme, rest = "http", "//" + rest
    auth, path = py_authority(rest)
    if auth is None:
        return None
    host, port = py_port(auth)
    if not host:
        return None
    port = port or ("443" if scheme == "https" else "80")
    path = path.strip("/")
    return f"{scheme}://{host}:{port}/" + (path + "/" if path else "")


def py_host(u):
    _, rest = py_split(u)
    auth, path = py_authority(rest)
    return py_port(auth or path)[0]


def py_domain(host):
    octet = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    if re.match(rf"^({octet}\.){{3}}{octet}$", host):
        return host
    labels = host.split(".")
    if len(labels) < 3:
        return host
    return ".".join(labels[-3:] if "." + ".".join(labels[-2:]) in TWO_LABEL_SUFFIXES else labels[-2:])


def py_complete(page, link):
    scheme, _ = py_split(page)
    root = None if scheme is None else f"{scheme}://{py_host(page)}"
    done = None
    if link.startswith(("/", ".")):
        link = link.rstrip(".")
        done = urljoin(root, link) if root else link
    elif not re.match(r"(.+\..+)", link) or (
        len(link.split(".")) <= 2 and link.split(".")[-1] in PAGE_EXTENSIONS
    ):
        done = urljoin(page, link)
    return done or link


PIECES = [
    "http", "https", "ftp", "HTTP", "tel", "//", "://", "/", "/", ":", ":80", "8080", "a", "b.com", "www", ".",
    "..", "./", "../", "?", "?q=1", "#", "#f", ";", ";p=1", "=", "&", "@", " ", "com.cn", "10.0.0.1", "html",
    ".html", "é", "中", "-", "_", "%20", "x",
]
urls_drawn = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(urls_drawn, min_size=300, max_size=400))
def test_random_urls(spark, drawn):
    u = F.col("u")
    rows = spark.createDataFrame([(x,) for x in drawn], "u string").select(
        u, U.url_key(u), U.host_of(u), U.site_domain(U.host_of(u))
    )
    for got in rows.collect():
        x = got[0]
        assert tuple(got) == (x, py_key(x), py_host(x), py_domain(py_host(x)))


def test_random_links(spark):
    rnd = random.Random(11)
    word = lambda k: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, k)))
    starts = ["http://h.com:8080/p/q.html", "https://a.b.com", "http://h.com/p/;x?y=1#z", "h.com/p/q", "http://10.0.0.1/a/b/"]
    rows = [(rnd.choice(starts) if rnd.random() < 0.8 else "http://" + word(4), word(7)) for _ in range(6000)]
    got = links.resolve_links(spark.createDataFrame(rows, "url string, link string")).collect()
    wrong = [(r.url, r.link, r.resolved, py_complete(r.url, r.link)) for r in got if r.resolved != py_complete(r.url, r.link)]
    assert not wrong, wrong[:5]


def test_reports(spark):
    df = spark.createDataFrame(
        [("http://a.com:81/x", "ab"), ("http://a.com/y", "c"), ("b.com/z", None)], "url string, html string"
    )
    hosts = lambda **kw: {(r.host, r.pages, r.chars) for r in urls.rollup_by_host(df, **kw).collect()}
    assert hosts() == {("a.com", 2, 3), ("b.com/z", 1, None)}
    assert hosts(with_type=True) == {("http://a.com", 2, 3), (None, 1, None)}
    assert hosts(with_port=True) == {("a.com:81", 1, 2), (None, 2, 1)}
    assert {tuple(r) for r in urls.dedup_by_url_key(df, with_rest=False).collect()} == {
        ("http://a.com:81/", "http://a.com:81/x", 1),
        ("http://a.com:80/", "http://a.com/y", 1),
        ("http://b.com:80/", "b.com/z", 1),
    }
    u = spark.createDataFrame([("http://",), ("https://x",), ("http:\\\\x",), ("ftp://x",)], "url string")
    assert [r.url for r in urls.filter_urls(u).collect()] == ["https://x", "http:\\\\x"]


def test_level_is_checked(spark):
    df = spark.createDataFrame([], "url string, link string")
    with pytest.raises(ValueError):
        links.in_scope(df, 3)
