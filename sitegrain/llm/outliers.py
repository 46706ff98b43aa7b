"""Quality rules and robust multivariate outliers.

Statistics of each text are columns; base rules reject first. What passes is judged per
language and source: location and scatter are minimum-covariance-determinant estimates,
found by concentration steps (keep the closest share, estimate again) from a start at
medians and absolute deviations. Every step is one pass over narrow rows that ends in a
few numbers per group, so a hot group costs no more than its share of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import SPACES, let, words
from sitegrain.plans.staging import Staging

WINDOW = 8
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
#: Least spread of each feature. Most texts have no symbol and no repeat at all, so a group's
#: own spread can be zero.
FLOORS = (0.06, 0.05, 0.15, 0.11)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows found twice or more."""

    def covered(s: Column) -> Column:
        twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
            lambda a, p: F.struct((p + WINDOW).alias("end"), (a["total"] + p + WINDOW - F.greatest(a["end"], p)).alias("total")),
            lambda a: a["total"],
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Sorting is for the few texts that repeat a window.
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(F.lit(0))


def _word_stats(w: Column) -> Column:
    windows = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(windows, _repeat_words).cast("long").alias("n_repeat_words"),
    )


def _line_stats(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )


def text_stats(text: Column) -> Column:
    """A struct of the statistics of one text, all long; zeros for null."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda l: F.btrim(l, F.lit(SPACES)) != "")
    symbols = (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long")
    return let(
        F.struct(let(words(t), _word_stats).alias("w"), let(lines, _line_stats).alias("l"), symbols.alias("s")),
        lambda x: F.struct(
            x["w"]["n_words"].alias("n_words"),
            x["w"]["word_chars"].alias("word_chars"),
            x["s"].alias("n_symbols"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
            x["l"]["n_lines"].alias("n_lines"),
        ),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def features(s: Column) -> list[Column]:
    """Transformed statistics. Shares are taken with some mass added and as square roots, so
    short texts do not stand out by chance. The mean word length of a short text is drawn
    towards five characters for the same reason."""
    root = lambda part, whole, mass: F.sqrt(part / (whole + mass))
    return [
        F.log((s["word_chars"] + 250) / (s["n_words"] + 50)),
        root(s["n_symbols"], s["word_chars"], 50),
        root(s["n_dup_lines"], s["n_lines"], 5),
        root(s["n_repeat_words"], s["n_words"], 20),
    ]


def group_of(docs: DataFrame) -> Column:
    """Language and source as one text that is never null."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    return F.concat_ws("\x01", part("lang"), part("source"))


def chi2_cdf(x: float, p: int) -> float:
    """Distribution function of chi-square, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= half / k
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, p) < q:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def distance(x: list[Column], params: Column) -> Column:
    """Squared Mahalanobis distance, by forward substitution."""
    z: list[Column] = []
    for i, value in enumerate(x):
        rest = value - params[f"m{i}"]
        for j in range(i):
            rest = rest - params[f"l{i}{j}"] * z[j]
        z.append(rest / params[f"l{i}{i}"])
    return sum((v * v for v in z[1:]), z[0] * z[0])


_P = range(len(FEATURES))
_X = [f"x{i}" for i in _P]


def _packed(groups: DataFrame, cov) -> DataFrame:
    """``_g, _params``: centre and lower Cholesky factor of each group, written out as columns."""
    out = groups
    for i in _P:
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            factor = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", factor)
    return out.select("_g", F.struct(*[f"m{i}" for i in _P], *[f"l{i}{j}" for i in _P for j in range(i + 1)]).alias("_params"))


def fit_mcd(stats: DataFrame, stage: Staging, share: float = 0.75, steps: int = 3, min_rows: int = 50, accuracy: int = 2000) -> DataFrame:
    """Estimates per group: ``_g, _params``.

    ``stats`` has ``_g`` and one column per feature (``x0`` …), rows that passed the base
    rules only. ``share`` of a group's rows make up the subset of least determinant.
    Groups of fewer than ``min_rows`` rows get no estimate.
    """
    quantile = lambda c, q: F.percentile_approx(c, q, accuracy)
    centre = stage.write(
        stats.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *[quantile(x, 0.5).alias(f"m{i}") for i, x in enumerate(_X)]).where(F.col("_n") >= min_rows),
        "centre",
    )
    spread = (
        stats.join(centre, "_g")
        .groupBy("_g", "_n", *[f"m{i}" for i in _P])
        .agg(*[quantile(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, x in enumerate(_X)])
    )
    start = lambda i, j: F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)
    params = stage.write(_packed(spread, start), "start")
    cut = chi2_quantile(share, len(FEATURES))
    consistency = share / chi2_cdf(cut, len(FEATURES) + 2)
    for step in range(steps):
        with_params = stats.join(params, "_g").withColumn("_d", distance([F.col(x) for x in _X], F.col("_params")))
        bounds = with_params.groupBy("_g").agg(quantile("_d", share).alias("_bound"))
        near = with_params.join(stage.write(bounds, f"bounds{step}"), "_g").where(F.col("_d") <= F.col("_bound"))
        moments = near.groupBy("_g").agg(
            *[F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)],
            *[F.covar_pop(_X[i], _X[j]).alias(f"c{i}{j}") for i in _P for j in range(i + 1)],
        )
        scaled = lambda i, j: F.col(f"c{i}{j}") * consistency + (FLOORS[i] ** 2 if i == j else 0.0)
        params = stage.write(_packed(moments, scaled), f"params{step}")
    return params


def fit(docs: DataFrame, stage: Staging, min_rows: int = 50, **options) -> tuple[DataFrame, DataFrame]:
    """Statistics of all rows, staged (``doc_id, _g, _s, x0`` …), and the estimates of each
    group (``_g, _params``). Groups of fewer than ``min_rows`` rows share one."""
    stats = stage.write(
        docs.select("doc_id", group_of(docs).alias("_g"), text_stats(F.col("text")).alias("_s")).select(
            "doc_id", "_g", "_s", *[f.alias(x) for f, x in zip(features(F.col("_s")), _X, strict=True)]
        ),
        "stats",
    )
    good = stats.where(~base_failed(F.col("_s"))).select("_g", *_X)
    own = stage.write(good.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).select("_g", F.when(F.col("_n") < min_rows, "").otherwise(F.col("_g")).alias("_pool")), "pools")
    pooled = good.join(own, "_g").drop("_g").withColumnRenamed("_pool", "_g")
    params = fit_mcd(pooled, stage, min_rows=min_rows, **options).withColumnRenamed("_g", "_pool")
    return stats, stage.write(own.join(params, "_pool").select("_g", "_params"), "judged")


def verdict(level: float = 0.9999) -> Column:
    """Whether a row with ``_s``, its features and ``_params`` stays."""
    far = distance([F.col(x) for x in _X], F.col("_params")) > chi2_quantile(level, len(FEATURES))
    # One expression: parts of a conjunction would be pushed below and count the text's statistics again.
    return F.when(base_failed(F.col("_s")), False).otherwise(~F.coalesce(far, F.lit(False)))


def quality_report(docs: DataFrame, stage: Staging, level: float = 0.9999, **options) -> DataFrame:
    """Per row ``doc_id``, the statistics, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Languages and sources may be
    null: null is a value of its own. Groups too small for an estimate are judged together; if all of
    them are still too few, nothing but the base rules rejects. Repeated rows count as often as they occur. Ties at the bound of
    a concentration step all count as near.
    """
    stats, params = fit(docs, stage, **options)
    s = F.col("_s")
    return stats.join(params, "_g", "left").select(
        "doc_id",
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(s).alias("base_failed"),
        verdict(level).alias("kept"),
        distance([F.col(x) for x in _X], F.col("_params")).alias("distance"),
    )


def keep_good(docs: DataFrame, stage: Staging, level: float = 0.9999, **options) -> DataFrame:
    """Rows of ``docs`` that stay, with their columns. A row's verdict depends on its text and
    its group alone, so texts are read a second time and never shuffled."""
    _, params = fit(docs, stage, **options)
    row = docs.select(F.struct("*").alias("_row"), group_of(docs).alias("_g"), text_stats(F.col("text")).alias("_s"))
    row = row.select("_row", "_g", "_s", *[f.alias(x) for f, x in zip(features(F.col("_s")), _X, strict=True)])
    return row.join(params, "_g", "left").where(verdict(level)).select("_row.*")
