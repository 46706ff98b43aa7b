"""URL verdicts: fixed rules first, then words of host and path.

Host labels are runs of letters without blanks. Word counts of the pages' own texts give a
unigram model, and Viterbi splits each label into its likeliest words. A multinomial naive
Bayes model over host words and path tokens, learnt from the URLs that rules decide, judges
the rest. Labels, hosts and path shapes are handled once each; only the words that occur
inside some label are looked up, so no vocabulary is sent anywhere.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import lower_ascii
from sitegrain.plans.staging import Staging


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(h: Column, p: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one. Of rules of one length
    the first by code point wins."""
    text, verdict = None, None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return text if text is not None else F.lit(None).cast("string"), verdict if verdict is not None else F.lit(None).cast("string")


def path_shape(p: Column) -> Column:
    """Path with runs of digits as one 0, lower-cased."""
    return F.regexp_replace(lower_ascii(p), "[0-9]+", "0")


def path_tokens(shape: Column) -> Column:
    return F.filter(F.split(shape, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_counts(html: DataFrame) -> DataFrame:
    """``word, n`` of runs of letters outside tags, scripts and styles, lower-cased."""
    shown = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)", " ")
    text = F.regexp_replace(shown, r"(?s)<[^>]*+>", " ")
    return (
        html.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
        .where(F.col("word") != "")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def best_split(label: str, log: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Likeliest words of a label. ``log`` has start and length of known words; a run of letters
    that is no word costs ``unknown`` and a tenth of the rest for each further letter. Of equal
    splits the one with the longest last words wins."""
    n, fade = len(label), math.log(0.1)
    known = defaultdict(list)
    for (start, length), value in sorted(log.items()):
        known[start + length].append((start, value))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    run, begin = -math.inf, 0  # best split that ends in unknown letters, and where those begin
    for end in range(1, n + 1):
        if best[end - 1] + unknown > run + fade:
            run, begin = best[end - 1] + unknown, end - 1
        else:
            run += fade
        best[end], back[end] = run, begin
        for start, value in known[end]:
            score = best[start] + value
            if score > best[end] or (score == best[end] and start < back[end]):
                best[end], back[end] = score, start
    words, end = [], n
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """``label, words`` for distinct ``label``. Every part of a label that is as long as some word
    is looked up in the counts. The driver learns which lengths words have, up to the longest label."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    longest = labels.agg(F.max(F.length("label"))).first()[0] or 0
    lengths = sorted(r[0] for r in counts.select(F.length("word").alias("l")).where(F.col("l") <= longest).distinct().collect())
    most = lengths[-1] if lengths else 0
    # Parts go by a key, for a label may be long; each is cut from the piece behind its start.
    starts = F.transform(F.sequence(F.lit(0), F.length("label") - 1), lambda i: F.struct(i.alias("start"), F.substring("label", i + 1, F.lit(most)).alias("rest")))
    fits = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("p.rest"))
    parts = (
        labels.where("label <> ''")
        .select(F.md5("label").alias("_id"), F.explode(starts).alias("p"))
        .select("_id", "p.start", "p.rest", F.explode(fits).alias("length"))
        .select("_id", "start", "length", F.substring("rest", F.lit(1), F.col("length")).alias("word"))
    )
    found = parts.join(counts, "word").groupBy("_id").agg(F.collect_list(F.struct("start", "length", "n")).alias("known"))
    unknown = math.log(1 / (total + 1)) + math.log(0.1)

    @F.pandas_udf("array<string>")
    def split(names: pd.Series, known: pd.Series) -> pd.Series:
        def one(name, parts):
            parts = [] if parts is None else parts
            return best_split(name, {(p["start"], p["length"]): math.log(p["n"] / total) for p in parts}, unknown)

        return pd.Series([one(a, b) for a, b in zip(names, known, strict=True)])

    return labels.withColumn("_id", F.md5("label")).join(found, "_id", "left").select("label", split("label", "known").alias("words"))


def host_words(hosts: DataFrame, counts: DataFrame, stage: Staging) -> DataFrame:
    """``host, words``: words of all its labels, for distinct ``host``."""
    labels = hosts.select("host", F.explode(F.split("host", r"[^\p{L}]+")).alias("label")).where("label <> ''")
    split = stage.write(segment(labels.select("label").distinct(), counts), "segments")
    return hosts.join(labels.join(split, "label").groupBy("host").agg(F.flatten(F.sort_array(F.collect_list("words"))).alias("words")), "host", "left")


def judge(pages: DataFrame, stage: Staging, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` per row of ``pages``.

    ``score`` is the log odds of blocking; above 0 blocks where no rule fits. Null URLs and URLs
    without ``://`` have an empty host and path, hence no rule and no token, and the prior decides.
    Null html counts no word. Without URLs that rules allow and block alike nothing is blocked.
    Repeated rows are judged each, and count as often in learning.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = stage.write(
        pages.select("page_id", h.alias("host"), p.alias("path")).select("page_id", "host", "path", path_shape(F.col("path")).alias("shape"), rule.alias("rule"), verdict.alias("ruled")), "urls"
    )
    counts = stage.write(word_counts(pages.select("html")), "words")
    is_block, is_allow = F.count_if(F.col("ruled") == "block"), F.count_if(F.col("ruled") == "allow")
    hosts = stage.write(host_words(urls.groupBy("host").agg(is_block.alias("block"), is_allow.alias("allow")), counts, stage), "hosts")
    shapes = stage.write(
        urls.groupBy("shape").agg(is_block.alias("block"), is_allow.alias("allow")).withColumn("words", path_tokens(F.col("shape"))), "shapes"
    )

    def tokens(df, prefix):
        return df.select("*", F.explode("words").alias("t")).withColumn("t", F.concat(F.lit(prefix), "t"))

    model = (
        tokens(hosts, "h ").select("t", "block", "allow")
        .unionByName(tokens(shapes, "p ").select("t", "block", "allow"))
        .groupBy("t").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
        .where("block + allow > 0")
    )
    model = stage.write(model, "model")
    size = model.agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.count(F.lit(1)).alias("v")).first()
    prior = hosts.agg(F.sum("block").alias("b"), F.sum("allow").alias("a")).first()
    log_prior = math.log(prior["b"] / prior["a"]) if prior["b"] and prior["a"] else None
    norm = math.log(((size["a"] or 0) + size["v"] + 1) / ((size["b"] or 0) + size["v"] + 1))
    odds = model.select("t", (F.log((F.col("block") + 1.0) / (F.col("allow") + 1.0)) + norm).alias("odds"))

    def score(df, prefix, key, name):
        return stage.write(tokens(df, prefix).join(odds, "t").groupBy(key).agg(F.sum("odds").alias(name)), name)

    total = F.lit(log_prior).cast("double") + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    return (
        urls.join(score(hosts, "h ", "host", "host_odds"), "host", "left")
        .join(score(shapes, "p ", "shape", "path_odds"), "shape", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(total > 0, "block").otherwise("allow")).alias("verdict"), total.alias("score"))
    )
