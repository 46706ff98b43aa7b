"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitegrain.llm import chat, language_id, language_model, lines, mixing, ngram_join, outliers, surrogates, url_words, winnowing

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (None, None, None, None), (None, "a b", None, "s"), (1, "", "en", None), (1, "", "en", None), (2, None, "de", "s"), (3, "\n\n", "en", "s"),
    (4, "One line here of some length\nOne line here of some length", "en", "s"), (5, "one LINE here of some length \nother", "en", "s"),
    (6, LONG, "en", "s"), (7, LONG, "en", "t"), (7, LONG, "en", "t"),
]
REPORTS = {
    "language": lambda d, b, s: language_id.language_report(d, with_spans=True),
    "surrogates": lambda d, b, s: surrogates.surrogate_report(d, s),
    "mixing": lambda d, b, s: mixing.mix_report(d, s),
    "quality": lambda d, b, s: outliers.quality_report(d, s),
    "decontamination": lambda d, b, s: winnowing.contamination_report(d, b, s),
    "lines": lambda d, b, s: lines.line_report(d, s),
    "ngrams": lambda d, b, s: ngram_join.component_report(d, s),
    "model": lambda d, b, s: language_model.score_report(d, s),
}


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, None), (None, "one line here"), (2, ""), (3, "other")], "item_id long, text string")


@pytest.mark.parametrize("name", REPORTS)
def test_odd_rows_are_all_reported(docs, benchmark, stage, name):
    out = REPORTS[name](docs(*ROWS), benchmark, stage).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == sorted((r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", REPORTS)
def test_empty_tables(docs, benchmark, stage, name):
    assert REPORTS[name](docs(), benchmark.where("false"), stage).count() == 0


def test_values_of_odd_rows(docs, benchmark, stage):
    d = docs(*ROWS)
    by = lambda df: {(r["doc_id"] or 0): r for r in df.collect() if r["doc_id"] is not None}
    lang = by(REPORTS["language"](d, benchmark, stage))
    assert (lang[2]["lang_pred"], lang[2]["score"]) == ("und", 0.0) == (lang[3]["lang_pred"], lang[3]["score"])
    cut = by(lines.line_report(d, stage))
    assert (cut[1]["n_lines"], cut[4]["n_dropped"], cut[5]["n_dropped"]) == (1, 0, 1)
    assert cut[5]["kept_sha256"] == hashlib.sha256(b"other").hexdigest()
    hit = by(winnowing.contamination_report(d, benchmark, stage))
    assert (hit[5]["n_hit"], hit[5]["n_items"], hit[4]["n_hit"]) == (4, 1, 6)  # "one line here" has no id to list
    near = by(ngram_join.component_report(d, stage))
    assert (near[6]["component_id"], near[7]["component_id"], near[3]["n_shingles"], near[3]["component_id"]) == (6, 6, 0, 3)


def test_long_text_equals_short_ones(docs, stage):
    """Pieces of a long text do not change what is found in it."""
    text = "den er in\n" * 120_000 + "Mail to a.b@c.example or x.y@z.example now"
    d = docs((1, text, "de", "s"), (2, "the of and that in is", "en", "s"))
    assert {r["doc_id"]: r["n_entities"] for r in surrogates.surrogate_report(d, stage).collect()} == {1: 2, 2: 0}
    model = language_id.fit(d)
    spans = {r["doc_id"]: r["spans"] for r in language_id.predict(d.withColumn("held_out", F.lit(True)), model).collect()}
    assert spans[1][0]["start"] == 0 and spans[1][-1]["end"] == len(text)


def test_pipeline_stages_keep_clashing_columns(spark, docs, sf_dir):
    d = docs(*ROWS, *[(100 + i, f"Document number {i} says " + " ".join(f"w{i}q{j}" for j in range(40)), "en", "s") for i in range(5)])
    d = d.withColumns({"size": F.lit("x"), "node": F.lit(1), "token": F.lit(2), "key": F.lit(3), "root": F.lit(4)})
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, d, sf_dir)
        assert out.columns == d.columns, name
        ids = {r["doc_id"] for r in out.collect()}
        assert {100, 101, 102, 103, 104} <= ids, name
        assert step(spark, d.where("false"), sf_dir).count() == 0


def test_chat_odd_rows(spark, stage):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 0, " User ", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.repair(df, stage).collect()
    assert len(out) == len(rows)
    text = "".join(r["piece"] for r in sorted((r for r in out if r["conv_id"] == 2), key=lambda r: r["order"]))
    assert text == "<|user|>\nq<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.repair(df.where("false"), stage).count() == 0


def test_urls_odd_rows(spark, stage):
    rows = [(1, None, None), (2, "no scheme", "<p>x</p>"), (3, "http://A.COM", ""), (None, "http://x.net/es/1", "<b>word</b>"), (3, "http://A.COM", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = url_words.judge(df, stage).collect()
    assert len(out) == 5
    by = {r["page_id"]: r for r in out}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"]) == ("", "", None)
    assert (by[3]["host"], by[3]["path"], by[3]["rule"]) == ("a.com", "", None)  # an empty path does not begin with /
    assert (by[None]["rule"], by[None]["verdict"]) == ("net/es/", "block")
    assert url_words.judge(df.where("false"), stage).count() == 0
