"""b-bit MinHash, collocations and whitening against plain Python, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sitegrain.llm import blocks, collocations, minhash, whitening
from sitegrain.llm.queries import QUERIES

UPPER = {c: c + 32 for c in range(65, 91)}


def sets_of(texts, k=4):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        out[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return out


def classes(texts, similar=80):
    sets, root = sets_of(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similar * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def varied(seed, groups, members, length):
    """Groups of copies of copies, each with a few words changed."""
    rng, texts = random.Random(seed), {}
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(length)]
        own = []
        for _ in range(members):
            w = list(rng.choice(own)) if own and rng.random() < 0.5 else list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(length)] = f"n{rng.randrange(30)}"
            own.append(w)
            texts[len(texts)] = " ".join(w)
    return texts


@pytest.mark.parametrize("block", [2048, 16])
def test_minhash_classes(docs, stage, monkeypatch, block):
    """Also with groups dealt out over many small blocks."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block * 64)
    texts = varied(1, 3, 70, 90) | {1000: "one two", 1001: "one  TWO", 1002: "one two three", 1003: "", 1004: None, 1005: "", 1006: "a b c d e", 1007: "a b c d e"}
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(*texts.items()), stage).collect()}
    sets, want = sets_of(texts), classes(texts)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_overlaps_of_few_and_of_many():
    rng = np.random.default_rng(2)
    rows = [np.unique(np.concatenate((rng.choice(300, 40), rng.choice(10**6, 30)))).astype(np.uint64) for _ in range(120)]
    got = blocks.overlaps(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))))
    for i in range(0, 120, 7):
        for j in range(120):
            if i != j:
                assert got[i, j] == len(np.intersect1d(rows[i], rows[j]))


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(3)
    for shared in (0, 500, 800):
        one = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        two = np.concatenate((one[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)))
        least = minhash.minima(np.concatenate((one, two)), np.array([0, 1000, 2000]))
        s = minhash.signature(least)
        assert s.shape == (2, 4) and abs(minhash.estimate(s[0], s[1]) - shared / (2000 - shared)) < 0.2


def test_minhash_odd_rows(spark, docs, stage):
    rows = [(None, None), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, ""), (6, ""), (7, "word " * 50_000), (8, "word " * 60_000)]
    d = docs(*rows).selectExpr("*", "1 c", "'x' root", "2 key", "3 n", "4 cell", "5 sign")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d, stage).collect() if r["n_shingles"])
    assert got == [(0, 1, 5, False), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 7, True), (8, 1, 7, False)]
    assert minhash.near_duplicates(d, stage).count() == len(rows)
    assert minhash.near_duplicates(d.where("false"), stage).count() == 0


def every_phrase(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {(lang, w): a for (lang, w), a in f.items() if len(w) > 1 and a >= least}
    drop = set()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i : i + k])
                if 100 * a >= 100 * f[part]:
                    drop.add(part)
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) not in drop:
            score, cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


def test_collocations(docs, stage):
    rng = random.Random(5)
    words = [*"abcdefgh", "É", "日本", "ab c"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n"]) for _ in range(60)), rng.choice(["en", "de", None, "und"])) for i in range(80)]
    rows += [(100 + i, "the very same long passage of words that many rows repeat whole and unchanged every time " * 3, "en") for i in range(20)]
    rows += [(200, None, "fr"), (201, "", "fr"), (202, "A " * 3000, "en"), (None, "x", None)]
    got = collocations.collocations(docs(*rows), stage, least=8, top=50).collect()
    assert {tuple(r) for r in got} == every_phrase([(r[2], r[1]) for r in rows], 8, 50)
    assert len({r["lang"] for r in got}) == 3


def test_collocations_of_nothing(docs, stage):
    assert collocations.collocations(docs(), stage).count() == 0
    assert collocations.collocations(docs((1, "a b", "en")).selectExpr("*", "1 chunk", "2 own", "3 freq", "4 phrase"), stage).count() == 0


def test_chunks_hold_each_occurrence_once(docs, stage):
    import pyarrow as pa

    text = " ".join(f"w{i % 400}" for i in range(2000)) + ". end of it\nnew piece"
    _, chunks, own = collocations.parse(pa.array([text, None, "", ".", "one"]))
    assert own.sum() == 2000 + 3 + 2 + 1
    assert all(len(c.split(" ")) <= o + 4 for c, o in zip(chunks.to_pylist(), own, strict=True)) and len(set(chunks.to_pylist())) < len(chunks)


def plain_whitening(vectors, copies=None):
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    u, m = np.unique(x, axis=0, return_counts=True)
    w = m if copies else np.ones(len(u), np.int64)
    n, s = int(w.sum()), (u * w[:, None]).sum(0)
    y = u - s / n
    e, v = np.linalg.eigh((y * w[:, None]).T @ y / n)
    return x, n, s, e[::-1][:4], v[:, ::-1][:, :4], e.sum()


@pytest.mark.parametrize("by_count", [False, True])
def test_whitening(spark, stage, by_count):
    rng = np.random.default_rng(6)
    base = (rng.normal(0, 1, (150, 8)) @ rng.normal(0, 1, (8, 8)) + 5000).astype(np.float32)
    vectors = np.concatenate((base, base[:30], np.repeat(base[:1], 200, 0)))  # a hot vector
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df, stage, by_count=by_count).collect()}
    x, n, s, e, v, trace = plain_whitening(vectors, by_count)
    assert len(got) == 4 * len(vectors)
    for k in range(4):
        want = (x - s / n) @ v[:, k] / np.sqrt(e[k])
        mine = np.array([got[i, k + 1]["whitened"] for i in range(len(x))])
        assert np.abs(np.abs(mine) - np.abs(want)).max() < 1e-6 and abs(abs(mine @ want) - want @ want) < 1e-4
        assert got[0, k + 1]["explained"] == pytest.approx(e[k] / trace, rel=1e-6)
    for i in range(0, len(x), 9):
        r = got[i, 1]
        assert (r["n"], r["deviation"]) == (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))) and r["identity_error"] < 1e-6


def test_whitening_odd_rows(spark, stage):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [-0.0, 0.001]), (None, [0.0, 0.002]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [3.0, 1.0]), (9, [1.0]), (10, [2.0]), (11, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 x", "2 h", "3 dims", "4 w", "5 at")
    got = whitening.whiten(df, stage).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (6, 1), (6, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2), (9, 1), (10, 1)]
    zero = [r["whitened"] for r in got if r["vec_id"] in (6, None) and r["component"] == 1]
    assert zero[0] == zero[1]  # equal after scaling
    assert {r["n"] for r in got if r["vec_id"] in (9, 10)} == {2} and all(r["identity_error"] < 1e-9 for r in got)
    far = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [4e15, 3.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(far, stage).collect()} == {None}
    assert whitening.whiten(df.where("false"), stage).count() == 0


def test_whitening_of_the_table(spark, sf_dir):
    got = QUERIES["op13_whitening"](spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    assert len(got) == 4 * len(rows) and got.identity_error.max() < 1e-4 and got.explained.between(0, 1).all()
