"""The walk: a hand-made web graph, variants, and random graphs against plain Python."""

import base64
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from check import compare
from sitegrain.catalog.oracles import ORACLES
from sitegrain.catalog.queries import QUERIES
from sitegrain.errors import DuplicateNameError
from sitegrain.operators import fetch, routing
from sitegrain.plans.crawl import crawl, crawl_stats, fetch_log_lines, write_visits
from sitegrain.plans.dispatch import crawl_tasks
from sitegrain.sources import seeds

ROOT = "http://h.com"
A = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
GRAPH = [
    (ROOT + "/", A("/a", "/b/", "/a/", "http://o.com/", "javascript:x", "/x.jpg") + '<iframe src="/f"></iframe>'),
    (ROOT + "/a", A("/c", "/missing")),
    (ROOT + "/b/", "404 Not Found " + A("/d")),
    (ROOT + "/f", A("/", "/a")),
    (ROOT + "/c", A("/e")),
    (ROOT + "/d", "plain"),
    (ROOT + "/e", "plain"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(GRAPH, "url string, html string")


@pytest.fixture(scope="module")
def seed(spark):
    return spark.createDataFrame([(ROOT,)], "url string")


def rows(result):
    short = lambda k: k and k.replace("http://h.com:80", "")
    return sorted((r.depth, short(r.url_key), r.outcome, r.page_state == "kept") for r in result.visits.collect())


def test_golden_walk(pages, seed):
    result = crawl(seed, pages)
    assert rows(result) == [
        (0, "/", "success", True),
        (1, "/a/", "duplicate", False),
        (1, "/a/", "success", True),
        (1, "/b/", "success", False),
        (1, "/f/", "success", True),
        (2, "/a/", "duplicate", False),
        (2, "/c/", "success", True),
        (2, "/missing/", "failed", False),
    ]
    assert {r.url: r.page_text for r in result.results.collect()} == {
        ROOT: GRAPH[0][1],
        ROOT + "/a": GRAPH[1][1],
        ROOT + "/f": GRAPH[3][1],
        ROOT + "/c": GRAPH[4][1],
    }
    stats = crawl_stats(result.visits, seconds=3.0).first()
    assert (stats.downloads, stats.success, stats.useless, stats.useless_with_duplicates) == (6, 5, 1, 3)
    assert stats.speed == 2.0
    result.release()


def test_variants(spark, pages, seed):
    assert rows(crawl(seed, pages, max_depth=0)) == [(0, "/", "success", True)]
    outside = crawl(seed, pages, max_depth=1, level=2).visits.filter(F.col("url") == "http://o.com/").first()
    assert (outside.outcome, outside.depth) == ("failed", 1)
    denied = crawl(seed, pages, deny_urls=[ROOT + "/a"], deny_hosts=spark.createDataFrame([("o.com",)], "h string"))
    assert (1, "/a/", "duplicate", False) not in rows(denied)
    hooked = crawl(seed, pages, max_depth=0, hook=lambda t: F.lit("seen")).results.first()
    assert (hooked.task, hooked.page_text) == (ROOT, "seen")
    with pytest.raises(ValueError):
        crawl(seed, pages, level=5)
    with pytest.raises(ValueError):
        crawl(seed.withColumn("level", F.lit(9)), pages)
    assert crawl(seed.limit(0), pages).visits.count() == 0


def test_limits_per_seed(spark, pages):
    table = spark.createDataFrame(
        [("t0", ROOT, 0, 0), ("t1", ROOT, 2, 1), ("t2", "mailto:x", 0, 2)],
        "task string, url string, level int, max_depth int",
    )
    got = {}
    for r in crawl(table, pages).visits.collect():
        got.setdefault(r.task, set()).add((r.depth, r.url, r.outcome))
    assert got["t0"] == {(0, ROOT, "success")}
    assert (1, "http://o.com/", "failed") in got["t1"] and max(d for d, _, _ in got["t1"]) == 1
    assert got["t2"] == {(0, "mailto:x", "invalid")}


def test_redirects_replace_the_body_but_not_the_base(spark, seed):
    pages = spark.createDataFrame(
        [
            (ROOT, '<head><meta content="0;url=http://o.com/deep/x"></head>'),
            ("http://o.com/deep/x", A("y", "/z")),
            (ROOT + "/z", "end"),
        ],
        "url string, html string",
    )
    visits = crawl(seed, pages, max_depth=1, redirects=True).visits.filter("depth = 1")
    assert {(r.url, r.outcome) for r in visits.collect()} == {
        ("http://h.com/y", "failed"),
        ("http://h.com/z", "success"),
    }


def test_random_graphs_against_plain_python(spark):
    rnd = random.Random(9)
    n = 60
    links = {i: [rnd.randrange(n + 10) for _ in range(3)] + ([0] if rnd.random() < 0.4 else []) for i in range(n)}
    blank = {i for i in range(n) if rnd.random() < 0.1}
    url = lambda i: f"{ROOT}/p{i}"
    pages = spark.createDataFrame(
        [(url(i), "" if i in blank else A(*[f"/p{j}" for j in links[i]])) for i in range(n)], "url string, html string"
    )
    table = spark.createDataFrame([(url(i),) for i in range(0, n, 2)], "url string")

    want = set()
    for s in range(0, n, 2):
        visited, frontier = set(), {s}
        for depth in range(4):
            after = set()
            for p in frontier:
                if p in visited:
                    want.add((url(s), url(p), depth, "duplicate"))
                    continue
                visited.add(p)
                want.add((url(s), url(p), depth, "success" if p < n else "failed"))
                if p < n and p not in blank:
                    after |= set(links[p])
            frontier = after
    got = {(r.task, r.url, r.depth, r.outcome) for r in crawl(table, pages, max_depth=3).visits.collect()}
    assert got == want


def test_fetch_and_log(spark, tmp_path, pages):
    frontier = spark.createDataFrame([("t", ROOT), ("t", ROOT + "/nope"), ("t", "tel:1")], "task string, url string")
    fetched = fetch.fetch(frontier, pages)
    assert {(r.url, r.outcome) for r in fetched.collect()} == {
        (ROOT, "success"),
        (ROOT + "/nope", "failed"),
        ("tel:1", "invalid"),
    }
    write_visits(fetched, str(tmp_path / "visits"), str(tmp_path / "log"))
    log = seeds.read_fetch_log(spark, str(tmp_path / "log"))
    assert {tuple(r) for r in log.collect()} == {
        ("Success", ROOT),
        ("Failed", ROOT + "/nope"),
        ("Failed", "tel:1"),
    }
    assert fetch_log_lines(fetched).count() == 3


def test_frontier_operators(spark):
    frontier = spark.createDataFrame(
        [("t", "b", "k"), ("t", "a", "k"), ("u", "b", "k"), ("t", "c", "seen")], "task string, url string, url_key string"
    )
    visited = spark.createDataFrame([("t", "seen"), ("u", "other")], "task string, url_key string")
    assert {tuple(r) for r in fetch.frontier_new(frontier, visited).collect()} == {("t", "k", "a"), ("u", "k", "b")}


def test_deny_lists(spark):
    df = spark.createDataFrame([("http://a.x.com/1",), ("http://b.y.com/2",), ("http://c.z.com/3",), ("http://d.w.com/4",)], "url string")
    listed = spark.createDataFrame([("x.com",), ("x.com",)], "d string")
    kept = fetch.drop_denied(df, listed, ["b.y.com"], ["http://c.z.com/3"])
    assert [r.url for r in kept.collect()] == ["http://d.w.com/4"]


def test_one_url_under_two_limits_is_two_walks(spark):
    pages = spark.createDataFrame(
        [("http://a.com/", '<a href="/b">b</a>' + "x" * 1000), ("http://a.com/b", "text " * 300)], "url string, html string"
    )
    table = spark.createDataFrame(
        [("http://a.com/", 0, 0), ("http://a.com/", 0, 1), ("http://a.com/", 0, 1)], "url string, level int, max_depth int"
    )
    walk = crawl(table, pages)
    rows = walk.visits.filter("outcome = 'success'").groupBy("task_id").count().collect()
    assert sorted(r["count"] for r in rows) == [1, 2]
    assert sorted(r.url for r in walk.results.collect()) == ["http://a.com/", "http://a.com/", "http://a.com/b"]
    stats = crawl_stats(walk.visits).collect()
    assert sorted((r.task, r.downloads) for r in stats) == [("http://a.com/", 1), ("http://a.com/", 2)]


def test_handlers_share_one_table_of_bodies(spark, pages, tmp_path):
    registry, seen = routing.Registry(), []
    registry.register("spider")
    registry.register("a", hook=lambda t: F.upper(t), sinks={"2": lambda b: seen.append(("a2", b.columns, b.collect())), "1": lambda b: seen.append(("a1", b.columns, b.collect()))})
    registry.register("b", sinks={"1": lambda b: seen.append(("b1", b.columns, b.collect()))})
    rows = [(ROOT, 0, 0, "a"), (ROOT, 0, 0, "b"), (ROOT + "/c", 0, 0, "a"), (ROOT + "/e", 0, 0, ""), (ROOT + "/d", 0, 0, "none")]
    tasks = spark.createDataFrame(rows, "url string, level int, max_depth int, spider string")
    walk = crawl_tasks(tasks, pages, registry, str(tmp_path / "saved"))
    assert [name for name, _, _ in seen] == ["a1", "a2", "b1"]
    assert all(columns == ["task_id", "task", "url", "page_text"] for _, columns, _ in seen)
    text = dict(GRAPH)
    got = {name: {r.url: r.page_text for r in found} for name, _, found in seen}
    assert got["a1"] == got["a2"] == {ROOT: text[ROOT + "/"].upper(), ROOT + "/c": text[ROOT + "/c"].upper()}
    assert got["b1"] == {ROOT: text[ROOT + "/"]}
    assert [r.url for r in spark.read.parquet(str(tmp_path / "saved")).collect()] == [ROOT + "/e"]
    walk.release()


def test_walks_over_bytes(spark, seed):
    text = [
        (ROOT + "/", "한국어 문서입니다. 오늘은 날씨가 좋습니다. " + A("/a", "/b", "/c"), "euc-kr"),
        (ROOT + "/a", "Größe und Straße " + A("/d"), "utf-16"),
        (ROOT + "/b", "", "utf-8"),
        (ROOT + "/c", "404 Not Found", "utf-8"),
        (ROOT + "/d", "ende", "utf-8"),
    ]
    as_bytes = spark.createDataFrame([(u, bytearray(t.encode(c))) for u, t, c in text], "url string, html binary")
    as_text = spark.createDataFrame([(u, t) for u, t, _ in text], "url string, html string")
    walks = [crawl(seed, pages) for pages in (as_bytes, as_text)]
    found = [sorted((r.url, r.depth, r.outcome, r.page_state or "") for r in w.visits.collect()) for w in walks]
    assert found[0] == found[1] and (ROOT + "/b", 1, "success", "blank") in found[0] and (ROOT + "/d", 2, "success", "kept") in found[0]
    texts = [{r.url: r.page_text for r in w.results.collect()} for w in walks]
    assert texts[0] == texts[1] and len(texts[0]) == 3
    frontier = spark.createDataFrame([(ROOT + "/a",), (ROOT + "/nope",), ("tel:1",), (None,)], "url string")
    got = {r.url: (r.outcome, r.page_text) for r in fetch.fetch(frontier, as_bytes, body="html").collect()}
    assert got == {ROOT + "/a": ("success", text[1][1]), ROOT + "/nope": ("failed", None), "tel:1": ("invalid", None), None: ("invalid", None)}


def test_save_options_of_tasks_and_shared_sinks(spark, pages, tmp_path):
    registry, seen = routing.Registry(), []
    registry.register("spider")
    registry.register("a", sinks={"own": lambda b: seen.append("own")})
    registry.add_sink("some", lambda b: seen.append(("some", b.count())), ["a"])
    rows = [(ROOT + "/e", 0, 0, "", True, "x/y"), (ROOT + "/d", 0, 0, "", False, None), (ROOT + "/d", 0, 0, "", True, "x/y"), (ROOT + "/c", 0, 0, "a", True, None)]
    tasks = spark.createDataFrame(rows, "url string, level int, max_depth int, spider string, bs64 boolean, base_output_dir string")
    crawl_tasks(tasks, pages, registry, str(tmp_path / "saved")).release()
    assert seen == ["own", ("some", 1)]
    b64 = lambda u: base64.b64encode(u.encode()).decode()
    got = sorted((r.base_output_dir, r.host, r.file_name) for r in spark.read.parquet(str(tmp_path / "saved")).collect())
    assert got == [("output", "h.com", "http:{{h.com{d".replace(":", "}")), ("x/y", "h.com", b64(ROOT + "/d")), ("x/y", "h.com", b64(ROOT + "/e"))]
    registry.add_sink("own", lambda b: None)
    with pytest.raises(DuplicateNameError):
        registry.sinks_of("a")
    assert list(registry.sinks_of("spider")) == ["own"]


def test_fetch_takes_one_page_of_a_url(spark):
    rows = [(3, "http://x.com/a", "z"), (1, "http://x.com/a", "y"), (2, "http://x.com/a", "x"), (4, "http://x.com/b", "b")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    frontier = spark.createDataFrame([("t", "http://x.com/a/"), ("t", "http://x.com/a"), ("t", "http://x.com/c")], "task string, url string")
    bodies = lambda **first: sorted((r.url[12:], r.body) for r in fetch.fetch(frontier, pages, body="html", **first).collect())
    assert bodies(first="page_id") == [("/a", "y"), ("/a/", "y"), ("/c", None)]
    assert bodies() == [("/a", "x"), ("/a/", "x"), ("/c", None)]


def test_a_walk_reads_every_capture_of_a_url(spark):
    blank, useless = "", "404 Not Found " + A("/no")
    rows = [
        (ROOT + "/a", A("/b", "/c")),
        (ROOT + "/a", A("/c", "/d", "/a")),
        (ROOT + "/a", A("/c")),
        (ROOT + "/a", blank),
        (ROOT + "/a", useless),
        (ROOT + "/a/", A("/e")),
        (ROOT + "/b", A("/f")),
        (ROOT + "/c", blank),
        (ROOT + "/c", blank),
    ]
    for html in ("html", "if(html = '', binary(html), encode(html, 'UTF-16')) AS html"):
        pages = spark.createDataFrame(rows, "url string, html string").selectExpr("url", html)
        walk = crawl(pages.select("url").filter("url like '%a%'"), pages, max_depth=2)
        got = sorted((r.task[12:], r.depth, r.url[12:], r.outcome, r.page_state) for r in walk.visits.collect())
        assert got == [
            ("/a", 0, "/a", "success", "kept"),
            ("/a", 1, "/a", "duplicate", None),
            ("/a", 1, "/b", "success", "kept"),
            ("/a", 1, "/c", "duplicate", None),
            ("/a", 1, "/c", "duplicate", None),
            ("/a", 1, "/c", "success", "blank"),
            ("/a", 1, "/d", "failed", None),
            ("/a", 2, "/f", "failed", None),
            ("/a/", 0, "/a/", "success", "kept"),
            ("/a/", 1, "/e", "failed", None),
        ]
        texts = sorted((r.task[12:], r.url[12:], r.page_text) for r in walk.results.collect())
        assert texts == sorted([("/a", "/a", t) for u, t in rows[:3]] + [("/a", "/b", rows[6][1]), ("/a/", "/a/", rows[5][1])])
        walk.release()


def test_a_link_without_a_page_of_its_url_takes_the_smallest_of_its_key(spark):
    rows = [(ROOT + "/s", A("/x//")), (ROOT + "/x/", A("/2")), (ROOT + "/x", A("/1"))]
    pages = spark.createDataFrame(rows, "url string, html string")
    walk = crawl(pages.limit(1).select("url"), pages, max_depth=2)
    assert sorted((r.depth, r.url[12:], r.outcome) for r in walk.visits.collect()) == [(0, "/s", "success"), (1, "/x//", "success"), (2, "/1", "failed")]
    assert sorted((r.url[12:], r.page_text) for r in walk.results.collect()) == [("/s", rows[0][1]), ("/x//", rows[2][1])]


def test_counts_of_captures_like_their_sql(spark, tmp_path):
    rows = [(1, ROOT + "/a", A("/b", "/c")), (2, ROOT + "/a", A("/c", "/a")), (3, ROOT + "/a/", A("/c")), (4, ROOT + "/c", "end")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(QUERIES["crawl_pages"](spark, str(tmp_path)), con, ORACLES["crawl_pages"]) == ""
