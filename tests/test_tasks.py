"""Seeds, task lines, defaults, routing, hooks and sinks."""

import pytest

from sitegrain.errors import DuplicateNameError
from sitegrain.operators import routing
from sitegrain.sources import seeds, tasks


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_seed_file(spark, tmp_path):
    listed = ".app .cc .pw .com .cn .co .top .net .gov.cn .edu.cn".split()
    (tmp_path / "sites.txt").write_text("\r\n".join(listed) + "\n a.b \nplain\n")
    assert [r.url for r in seeds.read_seeds(spark, str(tmp_path / "sites.txt")).collect()] == [".gov.cn", ".edu.cn", " a.b "]
    assert [r.url for r in seeds.seeds_from_list(spark, "a.com, b,,c d").collect()] == ["a.com", "b", "", "cd"]


def test_task_lines(spark):
    rows = lines(
        spark, ' {"url":"u","level":null} ', '{"url":"u"}', "123", "", "http://a.b", '"quoted"', '{"x":1}', "[1]",
        "null", " http://c.d　",
    )
    parsed = tasks.parse_tasks(rows, {"level": 1, "use_splash": True, "spider": None})
    assert [(r.kind, r.url) for r in parsed.collect()] == [
        ("json", "u"), ("json", "u"), ("reject", None), ("url", ""), ("url", "http://a.b"), ("json", "quoted"),
        ("reject", None), ("reject", None), ("reject", None), ("url", "http://c.d"),
    ]
    full = tasks.resolve_task_defaults(parsed).collect()
    assert [(r.url, r.level, r.use_splash) for r in full] == [
        ("u", None, False), ("u", 0, False), ("", 1, True), ("http://a.b", 1, True), ("quoted", 0, False),
        ("http://c.d", 1, True),
    ]
    assert full[0].timeout == 300 and full[0].max_depth == 2 and full[0].spider is None
    assert [r.level for r in tasks.typed_task_options(parsed).collect()][:3] == [None, None, None]
    with pytest.raises(ValueError):
        tasks.parse_tasks(rows, {"colour": 1})


def test_task_file_and_extra_urls(spark, tmp_path):
    (tmp_path / "t.txt").write_text('{"url":"u","max_depth":"5"}\nv\n')
    read = tasks.read_tasks(spark, str(tmp_path / "t.txt"), {"max_depth": 1})
    both = tasks.union_tasks(read, spark.createDataFrame([("w",)], "url string"), {"max_depth": 7})
    got = {(r.kind, r.url, r.max_depth) for r in tasks.typed_task_options(both).collect()}
    assert got == {("json", "u", 5), ("url", "v", 1), ("url", "w", 7)}


def test_routing(spark):
    registry = routing.Registry()
    registry.register("spider")
    registry.register("news", hook=lambda c: c)
    with pytest.raises(DuplicateNameError):
        registry.register("news")
    rows = spark.createDataFrame([("a", None), ("b", "news"), ("c", "gone"), ("d", "")], "url string, spider string")
    table = registry.table(spark)
    assert {(r.url, r.spider, r.known) for r in routing.route_tasks(rows, table).collect()} == {
        ("a", "spider", True), ("b", "news", True), ("c", "gone", False), ("d", "spider", True)
    }
    assert [r.url for r in routing.unknown_tasks(rows, table).collect()] == ["c"]


def test_sinks_run_in_name_order(spark):
    seen = []
    sinks = {"b": lambda d: seen.append(("b", d.count())), "a": lambda d: seen.append(("a", d.count()))}
    routing.run_sinks(spark.range(3), sinks)
    assert seen == [("a", 3), ("b", 3)]
    batch = spark.createDataFrame([("t", "u", "x"), ("t", "v", "y")], "task string, url string, page_text string")
    assert [r.results for r in routing.result_batches(batch).collect()] == [{"u": "x"}, {"v": "y"}]


def test_raw_page_names_stay_in_their_folder(spark, tmp_path):
    from sitegrain.sources import seeds

    rows = [("../../escaped.txt", "a"), ("a/b", "b"), ("c", None)]
    assert seeds.write_raw_pages(spark.createDataFrame(rows, "name string, body string"), str(tmp_path / "in" / "deep"), "name", "body") == 3
    files = sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert files == ["..{..{escaped.txt", "a{b", "c"] and all(p.is_relative_to(tmp_path / "in" / "deep") for p in tmp_path.rglob("*") if p.is_file())
    for bad in ("..", "", None):
        with pytest.raises(ValueError):
            seeds.write_raw_pages(spark.createDataFrame([(bad, "x")], "name string, body string"), str(tmp_path / "x"), "name", "body")
