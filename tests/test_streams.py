"""Streams give what the batch operators give, also over several micro-batches."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from check import compare
from sitegrain.catalog.oracles import ORACLES
from sitegrain.catalog.queries import QUERIES
from sitegrain.operators import links, search
from sitegrain.streaming import jobs


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    events.repartition(4).write.parquet(str(tmp_path / "events"))
    return events, str(tmp_path / "events")


def test_upsert_over_micro_batches(spark, event_files, tmp_path):
    events, path = event_files
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    jobs.run_upsert(jobs.stream_table(spark, path, events.schema, max_files=1), out, checkpoint)
    assert spark.read.parquet(out).select("batch").distinct().count() == 4
    want = sorted(search.latest_per_key(events, keys, order).collect())
    assert sorted(jobs.read_upserted(spark, out, keys, order).collect()) == want
    jobs.run_upsert(jobs.stream_table(spark, path, events.schema, max_files=1), out, checkpoint)
    assert spark.read.parquet(out).count() == events.count()
    jobs.compact_upserted(spark, out, str(tmp_path / "compact"), keys, order)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == len(want)
    assert sorted(jobs.read_upserted(spark, str(tmp_path / "compact"), keys, order).collect()) == want


def test_totals_over_micro_batches(spark, event_files, tmp_path):
    events, path = event_files
    out = str(tmp_path / "out")
    totals = jobs.count_by(jobs.stream_table(spark, path, events.schema, max_files=1), "event_type")
    jobs.run_totals(totals, out, str(tmp_path / "checkpoint"))
    assert sorted(jobs.read_totals(spark, out, str(tmp_path / "checkpoint"), totals.schema).collect()) == sorted(jobs.count_by(events, "event_type").collect())


def test_links_stream_like_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    stream = jobs.stream_table(spark, sf_dir, pages.schema, "pages.parquet")
    jobs.run_append(jobs.stream_links(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(links.extract_links(pages).collect())


@pytest.mark.parametrize("name", ["stream_links", "stream_sinks", "stream_upsert_pages"])
def test_queries_on_a_table_of_several_files(spark, sf_dir, tmp_path, name):
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) == ""


def test_dedup(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("k", t0 + timedelta(seconds=s)) for s in (0, 3, 9, 12)] + [("j", t0 + timedelta(seconds=1))]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.stream_table(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    jobs.run_append(jobs.dedup_tasks(stream(), ["k"], "ts"), str(tmp_path / "a"), str(tmp_path / "ca"))
    got = sorted((r.k, (r.ts - t0).seconds) for r in spark.read.parquet(str(tmp_path / "a")).collect())
    assert got == [("j", 1), ("k", 0), ("k", 12)]
    windows = jobs.dedup_tasks_per_window(stream(), ["k"], "ts")
    jobs.run_append(windows, str(tmp_path / "b"), str(tmp_path / "cb"))
    got = {(r.k, (r.window_start - t0).seconds) for r in spark.read.parquet(str(tmp_path / "b")).collect()}
    assert got == {("k", 0), ("k", 10), ("j", 0)}


def test_task_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text('{"url":"a"}\n')
    (tmp_path / "in" / "2.txt").write_text("b\n5\n")
    seen = []
    sinks = {
        "z": lambda d: seen.append("z"),
        "a": lambda d: seen.extend(sorted((r.kind, r.url) for r in d.collect())),
    }
    stream = jobs.stream_tasks(spark, str(tmp_path / "in"), max_files=5).select("kind", "url")
    jobs.run_sinks_per_batch(stream, sinks, str(tmp_path / "checkpoint"))
    assert seen == [("json", "a"), ("reject", None), ("url", "b"), "z"]


def test_a_sink_takes_a_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a\nb\n")
    seen, broken = [], [True]

    def second(d):
        if broken:
            broken.clear()
            raise OSError("full")
        seen.append(("second", d.count()))

    sinks = {"1 first/x": lambda d: seen.append(("first", d.count())), "2": second}
    stream = lambda: jobs.stream_tasks(spark, str(tmp_path / "in"), max_files=5).select("kind", "url")
    with pytest.raises(Exception, match="full"):
        jobs.run_sinks_per_batch(stream(), sinks, str(tmp_path / "checkpoint"))
    assert seen == [("first", 2)]
    jobs.run_sinks_per_batch(stream(), sinks, str(tmp_path / "checkpoint"))
    assert seen == [("first", 2), ("second", 2)]
    (tmp_path / "in" / "2.txt").write_text("c\n")
    jobs.run_sinks_per_batch(stream(), sinks, str(tmp_path / "checkpoint"))
    assert seen[2:] == [("first", 1), ("second", 1)]


def walked(rows, age):
    """Rows of (key, seconds) that are let through."""
    out, last = [], {}
    for k, s in sorted(set(rows), key=lambda r: r[1]):
        if k not in last or s - last[k] >= age:
            out.append((k, s))
            last[k] = s
    return sorted(out)


@pytest.mark.parametrize("files", [1, 10])
def test_dedup_in_one_batch_and_in_ten(spark, tmp_path, files):
    import random

    rng, t0 = random.Random(1), datetime(2024, 1, 1)
    rows = sorted(((rng.choice("abc"), rng.randrange(600)) for _ in range(300)), key=lambda r: r[1]) + [("a", 3600), ("a", 7200)]
    size = -(-len(rows) // files)
    for i in range(files):
        part = [(k, t0 + timedelta(seconds=s), 2**60 + s, None) for k, s in rows[i * size : (i + 1) * size]]
        spark.createDataFrame(part, "k string, ts timestamp, big long, nothing int").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    for i in range(files):  # one file at a time, in the order of their rows
        stream = jobs.stream_table(spark, str(tmp_path / "in" / ("*" if files == 1 else "{" + ",".join(map(str, range(i + 1))) + "}")), schema)
        jobs.run_append(jobs.dedup_tasks(stream, ["k"], "ts", 10), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, int((r.ts - t0).total_seconds())) for r in out) == walked(rows, 10)
    assert all(r.big == 2**60 + int((r.ts - t0).total_seconds()) and r.nothing is None for r in out)


def test_dedup_calls_python_once_a_bucket(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    keys = [(i, None if i % 3 else "x", -0.0 if i % 2 else 0.0) for i in range(300)] + [(0, "x", -0.0)]
    files = [[(*k, t0 + timedelta(seconds=s)) for k in keys for s in seconds] for seconds in ((0, 3, 12), (15, 22), (90,), (95, 101))]
    schema = "i int, s string, f double, ts timestamp"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        deduped = jobs.dedup_tasks(stream, ["i", "s", "f"], "ts", 10, buckets=5)
        jobs.run_append(deduped, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    out = [(r.i, r.s, r.f, (r.ts - t0).seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(out, key=repr) == sorted(((i, s, 0.0, t) for i, s, _ in keys[:300] for t in (0, 12, 22, 90, 101)), key=repr)
    state = spark.read.format("statestore").load(str(tmp_path / "checkpoint"))
    assert 0 < state.count() <= 5
    assert state.selectExpr("explode(value.groupState.keys)").count() == 300


def test_page_upsert_replaces_and_replays(spark, tmp_path):
    t0, schema = datetime(2024, 1, 1), "task string, url string, page_text string, update_time timestamp"
    path, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    batches = [[("t", f"u{i}", f"old {i}", t0) for i in range(30)], [("t", "u1", "new", t0 + timedelta(1)), ("t", "u2", "late", t0 - timedelta(1)), ("t", "u99", "first", t0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        before = jobs.page_store(spark, path).manifest()
        jobs.run_page_upsert(stream, path, checkpoint)
        after = jobs.page_store(spark, path).manifest()
    changed = [b for b, v in after["files"]["results"].items() if before["files"]["results"].get(b) != v]
    assert 1 <= len(changed) <= 3  # a batch of three pages touches three buckets at most
    results, contents = jobs.read_page_store(spark, path)
    texts = {r["url"]: bytes(r["content"]).decode() for r in results.join(contents, F.col("ref_content_id") == F.col("content_id")).collect()}
    assert texts == {f"u{i}": f"old {i}" for i in range(30)} | {"u1": "new", "u99": "first"}
    assert contents.count() == results.count() == 31  # what was replaced is gone
    store, query = jobs.page_store(spark, path), jobs._query_id(spark, checkpoint)
    assert not store.apply(spark.createDataFrame(batches[1], schema), None, query, 1)  # replayed: not even looked at
    assert store.manifest() == after


def test_tables_stay_whole_when_a_batch_dies(spark, tmp_path):
    from sitegrain.operators.keyed import KeyedTables

    rows = spark.createDataFrame([(i, i) for i in range(20)], "k int, v int")
    tables = KeyedTables(spark, str(tmp_path / "t"), ["k"], {"one": rows.schema, "two": rows.schema}, 4)
    assert tables.apply(rows, lambda now, new: {"one": new, "two": new}, "q", 0)

    def dies(now, new):
        return {"one": new.withColumn("v", F.lit(-1)), "two": new.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))}

    with pytest.raises(Exception, match="lost"):
        tables.apply(rows, dies, "q", 1)
    assert sorted(tables.read("one").collect()) == sorted(rows.collect())
    for i in range(1, 5):
        assert tables.apply(rows.where(f"k = {i}"), lambda now, new: {t: now[t].where(f"k <> {i}") for t in now}, "q", i)
    assert sorted(r.k for r in tables.read("two").collect()) == [0, *range(5, 20)]


def test_counters_equal_batch_counters(spark, tmp_path):
    import random

    from sitegrain.plans.crawl import crawl_stats

    rng = random.Random(2)
    rows = [(f"t{rng.randrange(9)}", rng.choice(["success", "failed", "duplicate"]), rng.choice(["kept", "blank", "useless", None])) for _ in range(200)]
    visits = spark.createDataFrame(rows, "task string, outcome string, page_state string")
    visits.repartition(4).write.parquet(str(tmp_path / "in"))
    counters = jobs.crawl_counters(jobs.stream_table(spark, str(tmp_path / "in"), visits.schema, max_files=1), "task")
    for _ in range(2):
        jobs.run_totals(counters, str(tmp_path / "out"), str(tmp_path / "c"), ["task"])
    want = crawl_stats(visits.withColumn("task_id", F.col("task"))).select("task", "downloads", "success", "useless")
    assert sorted(jobs.read_totals(spark, str(tmp_path / "out"), str(tmp_path / "c"), counters.schema, ["task"]).collect()) == sorted(want.collect())
