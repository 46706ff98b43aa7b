"""Results and contents: merge, update, delete, purge, search, export."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from sitegrain.catalog.queries import QUERIES
from sitegrain.errors import MissingRowsError
from sitegrain.operators import export, search, store
from sitegrain.plans.staging import Staging
from sitegrain.sources.seeds import read_raw_pages

T0 = datetime(2024, 1, 1)
BATCH = "task string, url string, page_text string, update_time timestamp"


def batch(spark, *rows):
    return spark.createDataFrame([(t, u, x, T0 + timedelta(hours=h)) for t, u, x, h in rows], BATCH)


def empty(spark):
    return store.Stored(spark.createDataFrame([], store.RESULTS), spark.createDataFrame([], store.CONTENTS))


def stored(s):
    joined = s.results.join(s.contents, F.col("ref_content_id") == F.col("content_id"))
    return {(r.task, r.url): bytes(r.content).decode() for r in joined.collect()}


def test_upsert_replaces_and_replays(spark):
    first = store.upsert_results(*empty(spark), batch(spark, ("t", "a", "old", 0), ("t", "b", "keep", 0)))
    change = batch(spark, ("t", "a", "new", 1), ("t", "a", "newest", 2), ("u", "a", "other", 1), ("t", "b", "late", -1))
    second = store.upsert_results(*first, change)
    want = {("t", "a"): "newest", ("t", "b"): "keep", ("u", "a"): "other"}
    assert stored(second) == want
    assert second.contents.count() == 3
    again = store.upsert_results(*second, change.union(change))
    assert stored(again) == want and again.contents.count() == 3
    assert {r.filename for r in again.contents.collect()} == {
        r[0] for r in spark.range(1).select(F.explode(F.array(F.md5(F.lit("a")), F.md5(F.lit("b"))))).collect()
    }


def test_put_and_read_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.html").write_bytes(b"\xc3\xa9")
    row = read_raw_pages(spark, str(tmp_path / "in")).first()
    assert row.filename.endswith("x.html") and row.length == 2 and bytes(row.content) == b"\xc3\xa9"
    put = store.put_contents(spark.createDataFrame([(7, "é")], "k int, body string"), "k", "body").first()
    assert (put.filename, put.length) == ("7", 2)
    store.insert(spark.range(2), str(tmp_path / "t"))
    store.insert(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_raw_pages_are_read_one_by_one(spark, sf_dir):
    sql = "SELECT page_id || '.html' AS name, strlen(coalesce(html, ''))::BIGINT AS length, md5(coalesce(html, '')) AS md5 FROM pages"
    assert compare(QUERIES["raw_pages"](spark, sf_dir), connect(sf_dir), sql) == ""


def test_update_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    up = lambda cond, val, **kw: [tuple(r) for r in store.update_rows(df, cond, val, **kw).orderBy("id").collect()]
    assert up({"id": 1}, {"v": "z"}) == [(1, "z"), (2, None)]
    assert up(F.col("v") == "a", {"id": F.col("id") + 10}) == [(2, None), (11, "a")]
    assert up({"v": None}, {"extra": 5}) == [(1, "a", None), (2, None, 5)]
    for nothing in ({"id": 9}, {"id": 1}):
        with pytest.raises(MissingRowsError):
            store.update_rows(df, nothing, {"v": "a"})
    assert up({"id": 9}, {"v": "a"}, ignore_missing=True) == [(1, "a"), (2, None)]
    assert up({"id": 9}, {"v": "q"}, upsert=True) == [(1, "a"), (2, None), (9, "q")]
    assert up({"id": 1}, {"v": "a"}, upsert=True) == [(1, "a"), (2, None)]


def test_versioned_update(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("b", 3, "x"), ("c", None, "x"), ("d", 1, "x")], "k string, version int, v string")
    sent = spark.createDataFrame([("a", 2, "y"), ("b", 3, "y"), ("c", 0, "y"), ("e", 0, "y")], "k string, version int, v string")
    table, outcomes = store.update_versioned(df, sent, ["k"])
    assert {tuple(r) for r in outcomes.collect()} == {
        ("a", "rejected", 3), ("b", "applied", 4), ("c", "applied", 1), ("e", "missing", None)
    }
    assert {tuple(r) for r in table.collect()} == {("a", 3, "x"), ("b", 4, "y"), ("c", 1, "y"), ("d", 1, "x")}


def test_one_of_several_updates_of_a_key_is_applied(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("b", 9, "x")], "k string, version int, v string")
    sent = spark.createDataFrame(
        [("a", 3, "y"), ("a", 4, "z"), ("a", 4, "z"), ("a", 1, "w"), ("b", 1, "y"), ("b", 2, "y"), ("c", 0, "y"), ("c", 0, "y")],
        "k string, version int, v string",
    )
    table, outcomes = store.update_versioned(df, sent, ["k"])
    assert sorted(tuple(r) for r in table.collect()) == [("a", 4, "z"), ("b", 9, "x")]
    assert Counter((r.k, r.status, r.version) for r in outcomes.collect()) == {
        ("a", "applied", 4): 1, ("a", "rejected", 4): 3, ("b", "rejected", 9): 2, ("c", "missing", None): 2
    }


def test_a_batch_that_cannot_be_repeated_keeps_its_contents(spark):
    stamped = spark.createDataFrame([("t", f"u{i}", f"text {i}") for i in range(50)], "task string, url string, page_text string")
    stamped = stamped.withColumn("update_time", F.current_timestamp() + F.make_dt_interval(secs=F.rand().cast("decimal(18,6)")))
    stored = store.upsert_results(*empty(spark), stamped)
    joined = stored.results.join(stored.contents, F.col("ref_content_id") == F.col("content_id"))
    assert joined.count() == stored.results.count() == stored.contents.count() == 50


def test_staged_upserts_can_be_released(spark, tmp_path):
    staging = Staging(spark, "released")
    stored = store.upsert_results(*empty(spark), batch(spark, ("t", "a", "x", 0)), staging)
    stored.results.write.parquet(str(tmp_path / "results"))
    staging.release()
    assert spark.read.parquet(str(tmp_path / "results")).count() == 1


def test_update_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "v int, k string").write.partitionBy("k").parquet(path)
    files = lambda k: sorted(p.name for p in (tmp_path / "p" / f"k={k}").glob("*.parquet"))
    before = files("a"), files("b")
    store.update_by_partition(spark, path, F.col("v") == 3, {"v": 30}, "k")
    assert files("a") == before[0] and files("b") != before[1]
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b"), (30, "b")}
    with pytest.raises(MissingRowsError):
        store.update_by_partition(spark, path, {"v": 99}, {"v": 1}, "k")
    store.update_by_partition(spark, path, {"v": 99}, {"v": 1}, "k", ignore_missing=True)


def test_delete_and_purge(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert [r.id for r in store.delete_rows(df, F.col("v") == "a").collect()] == [2]
    with pytest.raises(MissingRowsError):
        store.delete_rows(df, {"id": 5}, ignore_missing=False)
    logs = spark.createDataFrame([(1, T0), (2, T0 + timedelta(seconds=1))], "id int, at timestamp")
    now = F.lit(T0 + timedelta(days=31))
    assert [r.id for r in store.purge_by_whole_days(logs, "at", now=now).collect()] == [2]
    assert [r.id for r in store.purge_overdue(logs, "31 days", now + F.expr("interval 1 second"), "at").collect()] == [2]


def results(spark):
    return store.upsert_results(
        *empty(spark), batch(spark, ("t", "http://h/a?x", "A", 0), ("t", "http://h/b", "B", 1), ("u", "http://h/b", "C", 2))
    )


def test_delete_contents(spark):
    s = results(spark)
    left = store.delete_contents(*s, task="t")
    assert left.results.count() == 3 and left.contents.count() == 1
    assert export.missing_contents(*left).count() == 2
    assert store.delete_contents(*s, task="t", cascade=True).results.count() == 1
    assert store.delete_contents(*s, url="http://h/b").contents.count() == 2


def test_find_and_export(spark, tmp_path):
    s = results(spark)
    assert [r.url for r in search.find_results(s.results, task="t").collect()] == ["http://h/b", "http://h/a?x"]
    assert [r.task for r in search.find_results(s.results, url="http://h/b").collect()] == ["u"]
    with pytest.raises(ValueError):
        search.find_results(s.results)
    exported = export.export_pages(*s, task="t")
    assert {(r.file_name, r.page_text, r.host) for r in exported.collect()} == {
        ("http}{{h{a^x", "A", "h"), ("http}{{h{b", "B", "h")
    }
    assert export.first_page(*s, task="t").first().page_text == "B"
    export.write_by_host(exported, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    newest = search.latest_per_url(s.results)
    assert newest.columns == s.results.columns and newest.count() == 3


def test_content_by_name(spark):
    contents = store.put_contents(
        spark.createDataFrame([("n", "old", 1), ("n", "new", 2), ("m", "x", 3)], "k string, body string, i int"),
        "k", "body", F.col("i").cast("string"), F.timestamp_seconds("i"),
    )
    names = spark.createDataFrame([("n",), ("n",), ("zz",)], "filename string")
    assert [bytes(r.content) for r in store.content_by_name(contents, names).collect()] == [b"new"]


def test_file_names(spark):
    long = "http://h/" + "x" * 300
    df = spark.createDataFrame([("http://a/b?c*",), (long[:256],), (long[:255],)], "url string")
    a, b, c = [r.final_name for r in export.page_file_names(df).collect()]
    assert a == "http}{{a{b^c[" and len(b) == 32 and len(c) == 255
    b64 = [r.b64 for r in export.page_file_names(df).collect()]
    assert "\n" not in b64[1] and "\r" not in b64[1]


def test_paging(spark):
    df = spark.range(1, 101, numPartitions=7).select("id", (F.col("id") % 10).alias("v"))
    want = sorted(((i, i % 10) for i in range(1, 101)), key=lambda r: (-r[1], -r[0]))
    for offset, limit in ((0, 0), (0, 5), (1, 2), (37, 20), (95, 50), (40, 0), (100, 5), (250, 0)):
        rows, total = search.page_rows(df, "v", "id", offset, limit)
        got = [tuple(r) for r in rows.collect()]
        assert total == 100 and got == want[offset : offset + limit if limit else None], (offset, limit)


def test_pages_with_nulls_and_other_types(spark):
    values = [None, float("nan"), 1.5, None, 0.0, 1.5, -2.0]
    rows = [(f"k{i}", v, datetime(2024, 10, 27, i), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id string, v double, at timestamp, wide int")
    for sort, want in (("v", ["k1", "k5", "k2", "k4", "k6", "k3", "k0"]), ("at", [f"k{i}" for i in range(6, -1, -1)])):
        for offset in range(7):
            page, total = search.page_rows(df, sort, "id", offset, 2)
            assert (total, page.columns, [r.id for r in page.collect()]) == (7, df.columns, want[offset : offset + 2])
    page, total = search.page_rows(df, "v", "id", 0, 5, {"v": 1.5})
    assert total == 2 and [r.wide for r in page.collect()] == [5, 2]
    page, total = search.page_rows(df.where("false"), "v", "id", 0, 5)
    assert (total, page.count()) == (0, 0)


def test_small_searches(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "a", 7)], "id int, k string, v int")
    assert [tuple(r) for r in search.find(df, {"k": "a"}, ["v"], "id").collect()] == [(1, 5), (3, 7)]
    assert [r.id for r in search.find(df, {"v": None}).collect()] == [2]
    assert search.count_matching(df, {"k": "a"}).first().n == 2
    assert search.find_one(df, {"k": "a"}, [F.desc("id")]).first().id == 3
    with pytest.raises(ValueError):
        search.find_one(df)
    page, total = search.aggregate_paged(df, lambda d: d.groupBy("k").count(), [F.desc("count")], 1, 1)
    assert (total, page.first().k) == (2, "b")


def test_null_times_names_and_partitions(spark, tmp_path):
    """Nulls are neither purged nor lost, and the null partition is updated too."""
    times = spark.sql("SELECT * FROM VALUES (1, timestamp'2020-01-01'), (2, null), (3, timestamp'2030-01-01') AS t(id, update_time)")
    now = F.lit("2030-01-02").cast("timestamp")
    assert sorted(r.id for r in store.purge_overdue(times, "30 days", now).collect()) == [2, 3]
    assert sorted(r.id for r in store.purge_by_whole_days(times, "update_time", 30, now).collect()) == [2, 3]
    contents = spark.sql("SELECT 'c1' content_id, 'f' filename, cast(null AS timestamp) upload_date")
    names = spark.sql("SELECT 'f' filename")
    assert [r.content_id for r in store.content_by_name(contents, names).collect()] == ["c1"]
    path = str(tmp_path / "t")
    spark.sql("SELECT * FROM VALUES (1, 'x', 'p'), (2, 'x', null), (3, 'y', null) AS t(id, v, part)").write.partitionBy("part").parquet(path)
    store.update_by_partition(spark, path, {"v": "x"}, {"v": "z"}, "part")
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "z", 2: "z", 3: "y"}
    with pytest.raises(MissingRowsError):
        store.delete_rows(times, F.col("id") == 9)


def test_a_failed_partition_update_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "a"), (2, "b"), (3, None), (4, "c d=/%")]
    spark.createDataFrame(rows, "v int, p string").write.partitionBy("p").parquet(path)
    with pytest.raises(Exception, match="lost"):
        store.update_by_partition(spark, path, F.col("v") < 3, {"v": F.when(F.col("v") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(9)}, "p")
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=repr) == sorted(rows, key=repr)
    store.update_by_partition(spark, path, F.col("v") > 1, {"v": F.col("v") * 10}, "p")
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=repr) == sorted([(1, "a"), (20, "b"), (30, None), (40, "c d=/%")], key=repr)
    assert not [x for x in (tmp_path / "t").iterdir() if x.name.startswith("_update")]
