"""Link attributes and address-like words."""

import html as stdlib_html
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from sitegrain.functions import html as H
from sitegrain.operators import links

MARKUP = """<A data-href="no" title='x>y' HREF=unq/a>1</a><a href>x</a><!-- <a href="c"> -->
<script>var t="<a href='s'>";</script><style>a{}</style><a class=b href = 'q"x' >
<iframe src="/f?a=1&amp;b=&eacute;&#233;&#x1F600;&copy=2&bogus;"></iframe><frame src='*'><a
href="multi
line"><abbr href="n"><area href="n2"><a title="href=zz" href="last" href="second"><a/href="slash">
<a href="javascript:x"><a href="mailto:x"><a href="/"><a href="*"><iframe src=" about:blank "><frame src=" ">"""


def test_attributes(spark):
    df = spark.createDataFrame([(1, MARKUP)], "page_id int, html string")
    anchors = [r.link for r in links.anchor_links(df).collect()]
    assert anchors == ["unq/a", "", 'q"x', "multi\nline", "last", "slash"]
    assert [r.link for r in links.frame_links(df).collect()] == ["/f?a=1&b=éé😀&copy=2&bogus;"]


def test_unclosed_regions_end_at_the_end(spark):
    cases = ['<a href="x"><!-- <a href="y">', '<a href="x"><script><a href="y">', '<a href="x"><a href="y']
    df = spark.createDataFrame(list(enumerate(cases)), "page_id int, html string")
    found = {}
    for r in links.anchor_links(df).collect():
        found.setdefault(r.page_id, []).append(r.link)
    assert found[0] == ["x"] and found[1] == ["x"] and found[2][0] == "x"


class Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        wanted = {"a": "href", "frame": "src", "iframe": "src"}.get(tag)
        values = [v for k, v in attrs if k == wanted]
        if wanted and values:
            self.found.append(values[0] or "")


def test_random_markup_against_a_parser(spark):
    rnd = random.Random(3)
    tags = ["a", "A", "iframe", "frame", "b", "abbr", "area"]
    names = ["href", "HREF", "src", "data-href", "title", "x"]
    values = ['"v1"', "'v2'", "v3", '"a>b"', "'a\"b'", '"x&amp;y"', '""', '"a b"', '"/p?q=1&amp;r=2"']

    def tag():
        attrs = " ".join(
            rnd.choice(names) + rnd.choice(["=", " = "]) + rnd.choice(values) for _ in range(rnd.randint(0, 4))
        )
        return f"<{rnd.choice(tags)} {attrs}>"

    extra = ["text", "<!-- <a href='no'> -->", "<script>if(a<b){'<a href=no>'}</script>", "</a>", "\n", "<br/>"]
    docs = ["".join(tag() if rnd.random() < 0.7 else rnd.choice(extra) for _ in range(12)) for _ in range(1500)]
    rows = spark.createDataFrame([(d,) for d in docs], "html string").select(
        "html", F.transform(H.link_attributes(F.col("html")), lambda e: e["link"]).alias("found")
    )
    for r in rows.collect():
        parser = Parser()
        parser.feed(r.html)
        assert r.found == parser.found, r.html


def test_character_references(spark):
    texts = ["a&amp;b&lt;&gt;&quot;", "&#65;&#x42;&#X43", "&eacute;&Eacute;&nbsp;", "a&b;c&", "&#0;x", "&amp;amp;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(H.unescape(F.col("t"))).collect()
    want = [stdlib_html.unescape(t) for t in texts]
    want[3], want[4] = "a&b;c&", "x"
    assert [r[0] for r in rows] == want


ADDRESS = re.compile(
    r"((((ht|f)tps?)://)?[\w\-]+(\.[\w\-]+)+([\w\-.,@?^=%&:/~+#]*[\w\-@?^=%&/~+#])?)", re.S
)


def test_random_texts_against_python(spark):
    rnd = random.Random(5)
    tokens = ["http", "https", "ftp", "://", "a", "b", ".", ".", "-", "_", "é", "中", "/", "?", "=", ",", ":", "@",
              "#", " ", "x", "s", "t", "p", "h", "&", "~", "+", "😀", "́", "1", "\n", '"', "http://", "a.b"]
    texts = ["".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 40))) for _ in range(20000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.addresses("t").alias("a"))
    for r in rows.collect():
        assert r.a == [m[0] for m in ADDRESS.findall(r.t)], r.t


def test_long_words_do_not_overflow(spark):
    texts = ["x" * 200_000, "a." * 100_000, "a.b" + "." * 200_000, "http" * 50_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sizes = dict(rows.select("i", F.size(H.addresses("t"))).collect())
    assert sizes == {0: 0, 1: 1, 2: 1, 3: 0}
    deep = "<a " + "x=1 " * 100_000 + 'href="y">' + "<!--" + "z" * 200_000
    found = spark.createDataFrame([(1, deep)], "page_id int, html string")
    assert [r.link for r in links.anchor_links(found).collect()] == ["y"]


def test_links_of_a_page_are_distinct_after_completion(spark):
    html = '<a href="/a"><a href="./a"><a href="/b.css"><a href="http://o.com/">see h.com and x.h.com'
    df = spark.createDataFrame([(1, "http://h.com/p", html)], "page_id int, url string, html string")
    at = lambda level: sorted(r.link for r in links.extract_links(df, level).collect())
    assert at(0) == ["h.com", "http://h.com/a"]
    assert at(1) == ["h.com", "http://h.com/a", "x.h.com"]
    assert at(2) == ["h.com", "http://h.com/a", "http://o.com/", "x.h.com"]


def test_script_and_style_end_at_their_own_tag(spark):
    page = """<script>var a="</style><a href='/bad'>"</script><a href='/good'><STYLE>a{}</script><a href='/no'></STYLE ><a href='/two'>"""
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert [r.link for r in links.anchor_links(df).collect()] == ["/good", "/two"]
