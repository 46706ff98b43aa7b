"""Physical plans: what is read, pushed down, shuffled and broadcast."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from sitegrain.operators import fetch, links, patterns, redirects, search, urls
from sitegrain.plans import crawl
from sitegrain.plans.crawl import page_graph
from sitegrain.plans.staging import Staging, staging_root


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def test_url_reports_do_not_read_bodies(pages, plan):
    for df in (urls.url_inventory(pages), urls.dedup_by_url_key(pages), urls.rollup_by_site_domain(pages)):
        assert "html" not in plan(df)


def test_page_work_needs_no_shuffle(pages, plan):
    for df in (
        links.anchor_links(pages),
        links.extract_links(pages, 1),
        links.text_urls(pages, "page_id", "html"),
        redirects.detect_redirects(pages),
        page_graph(pages),
    ):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text


def test_aggregates_combine_before_the_shuffle(pages, events, plan):
    for df in (urls.url_inventory(pages), search.latest_per_key(events, ["user_id"], ["ts", "event_id"])):
        text = plan(df)
        assert text.count("Aggregate (") >= 2 and text.count("Exchange (") == 1


def test_filters_reach_the_scan(events, plan):
    text = plan(search.find(events, {"event_type": "error"}, ["value"], "event_id"))
    assert "EqualTo(event_type,error)" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in text


def test_pages_gather_nothing(events, plan):
    """Skipped rows meet in no task, however small the page."""
    for offset, limit in ((10, 20), (10, 0), (0, 20)):
        rows, _ = search.page_rows(events.select("event_id", "value"), "value", "event_id", offset, limit)
        text = plan(rows)
        assert "TakeOrdered" not in text and "SinglePartition" not in text and "Subquery" in text


def test_frontier_is_shuffled_once(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.createDataFrame([("t", "u", "k")], "task string, url string, url_key string")
        text = plan(fetch.frontier_new(frontier, frontier.select("task", "url_key")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in text and text.count("Exchange (") == 2


def test_a_round_moves_neither_pages_nor_visited_keys(spark, pages, plan):
    staging = Staging(spark, "layout")
    snapshot = staging.append_buckets(crawl.leading_pages(page_graph(pages), 8), "snapshot", 8, "url_key")
    keys = "task_id string, url_key string, first_url string, depth int"
    visited = staging.append_buckets(spark.createDataFrame([("t", "k", "u", 0)], keys), "visited", 8, "task_id", "url_key")
    visited = staging.append_buckets(spark.createDataFrame([("t", "l", "v", 1)], keys), "visited", 8, "task_id", "url_key")
    assert visited.count() == 2 and snapshot.count() == pages.count()
    frontier = spark.createDataFrame([("t", "u", "k"), ("t", "w", "m"), ("t", "x", None)], "task_id string, url string, url_key string")
    frontier = staging.write(frontier, "frontier")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arrivals, reached = crawl._arrivals(frontier, visited), crawl._reach(visited, snapshot)
        # One exchange each: of the frontier, and of the round's distinct keys.
        for df in (arrivals, reached):
            assert plan(df).count("Exchange (") == 1 and "Bucketed: true" in plan(df)
        assert {tuple(r) for r in arrivals.collect()} == {("t", "m", "w")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = set(staging._tables)
    staging.release()
    assert len(known) == 2 and not any(spark.catalog.tableExists(t) for t in known)


def test_phrases_are_met_by_joins_alone(spark, pages, plan):
    phrases = spark.createDataFrame([("x",), ("one whole word",)], "pattern string")
    text = plan(patterns.match_patterns(pages, phrases, "page_id", "html"))
    # A text moves at most once, and only to meet the phrases found for it.
    assert "Exchange hashpartitioning" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert not any(w in text for w in ("Python", "Arrow", "Pandas"))


def test_staging_uses_the_shared_folder(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    assert staging_root(spark) == str(shared)
    staging = Staging(spark, "x")
    assert staging.write(spark.range(3), "t").count() == 3
    assert staging.path.startswith(str(shared)) and list(Path(staging.path).rglob("*.parquet"))
    staging.release()
    assert not Path(staging.path).exists()


def test_a_cluster_without_a_shared_folder_is_refused():
    settings = {"spark.master": "yarn"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: settings.get(k, default)))
    with pytest.raises(RuntimeError):
        staging_root(session)
