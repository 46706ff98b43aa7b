"""Exact n-gram Jaccard join, by a blocked sparse product of documents and n-grams.

The incidence matrix has a row per distinct document and a column per n-gram. Columns are
split into blocks by hash. First pass: each block counts its columns, and a document whose
shared n-grams, added up over blocks, are below its size-derived bound has no partner. The
few rows that are left are ordered by frequency; a pair must meet in the rare part of both
and fit the bounds on sizes and positions.

Second pass: each row goes to the most central document that it meets, and the rows that
went to one place are multiplied with each other, block by block: overlaps are accumulated
over blocks of columns, and pairs below their bound discarded. Rows of different components
that still meet are grouped where sketches of their columns leave room for a link, and the
groups are multiplied in the same way. Blocks return spanning forests, never lists of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.arrays import NOT_SPACE, Words, grams, grams_inside, mix64, slices
from sitegrain.llm.bits import bit_table, known
from sitegrain.llm.blocks import by_cell, deal, forest, linked_sets
from sitegrain.llm.common import text_key
from sitegrain.llm.components import components
from sitegrain.plans.staging import Staging

#: Words of a shingle, and the similarity in hundredths.
SHINGLE, SIMILAR = 5, 75
#: Incidences of a column block of the first pass.
BLOCK_COLUMNS = 1 << 21
#: Members of a block that share a shingle, and shingles of a block of a group.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 18
#: Bits of a sketch.
SKETCH_BITS = 2048


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and where each text's begin. A text of fewer
    words is one shingle, a text without words none."""
    w = Words(texts, NOT_SPACE)
    counts = w.counts()
    token = grams(w.hash, k)
    at = np.flatnonzero(grams_inside(w.first, len(w.hash), k))
    rows, tokens = [np.searchsorted(w.first, at, "right") - 1], [token[at]]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            tokens.append(grams(w.hash, n)[w.first[short]])
    row, token = np.concatenate(rows), np.concatenate(tokens)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[new], token[new]
    return token, np.searchsorted(row, np.arange(len(texts) + 1))


def _set_ids(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number per distinct set; 0 for the empty one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(token ^ np.uint64(0x5851F42D4C957F2D)))))
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, mix64((sums[first[1:]] - sums[first[:-1]]) + size), 0).view(np.int64)


def _measure(k: int) -> Callable:
    """Set and size of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                token, first = shingles(part["text"], k)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["_k"], pa.array(np.diff(first).astype(np.int64)), pa.array(_set_ids(token, first))], ["doc_id", "_k", "n_shingles", "c"]
                )

    return run


def _column_blocks(k: int, bits: int) -> Callable:
    """A chunk's incidences, by block: sets, how many columns each has in the block, and the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"]):
                token, first = shingles(batch["text"].slice(lo, hi - lo), k)
                set_ids = _set_ids(token, first)
                _, keep = np.unique(set_ids, return_index=True)
                size = np.diff(first)
                keep = keep[size[keep] > 0]
                if not len(keep):
                    continue
                mine = np.zeros(len(size), bool)
                mine[keep] = True
                ids = set_ids[mine]
                token = token[np.repeat(mine, size)]
                row = np.repeat(np.arange(len(ids)), size[mine])
                block = (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
                order = np.argsort(block, kind="stable")
                row, block = row[order], block[order]
                column = ((token[order] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                edges = np.searchsorted(block, np.arange((1 << bits) + 1))
                out: list[list] = [[], [], [], []]
                for b in range(1 << bits):
                    s = slice(edges[b], edges[b + 1])
                    n = np.bincount(row[s], minlength=len(ids))
                    has = n > 0
                    if has.any():
                        for values, value in zip(out, (b, ids[has].tobytes(), n[has].astype(np.int32).tobytes(), column[s].tobytes()), strict=True):
                            values.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["block", "sets", "sizes", "columns"])

    return run


def _count_block(bits: int) -> Callable:
    """How many of its columns in a block each set shares with another one, packed into a row for
    each part of the sets."""

    def run(table: pa.Table) -> pa.Table:
        sets = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["sets"]])
        sizes = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["sizes"]])
        columns = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["columns"]])
        distinct, of = np.unique(sets, return_inverse=True)
        cell = (columns.astype(np.uint64) << np.uint64(32)) | np.repeat(of, sizes).astype(np.uint64)
        cell.sort()
        cell = cell[np.concatenate((np.ones(1, bool), cell[1:] != cell[:-1]))]  # copies of a set in several chunks
        column = (cell >> np.uint64(32)).astype(np.uint32)
        new = np.concatenate((np.ones(1, bool), column[1:] != column[:-1], np.ones(1, bool)))
        shared = ~(new[:-1] & new[1:])
        n = np.bincount((cell[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(distinct))
        distinct, n = distinct[n > 0], n[n > 0].astype(np.int32)
        part = (distinct.view(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange((1 << bits) + 1))
        parts = [(p, order[edges[p] : edges[p + 1]]) for p in range(1 << bits) if edges[p] < edges[p + 1]]
        return pa.table(
            {"part": pa.array([p for p, _ in parts], pa.int32()), "sets": pa.array([distinct[i].tobytes() for _, i in parts], pa.binary()), "shared": pa.array([n[i].tobytes() for _, i in parts], pa.binary())}
        )

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Counts of a part of the sets, added up over blocks."""
    sets = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["sets"]])
    shared = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table["shared"]])
    c, of = np.unique(sets, return_inverse=True)
    return pa.table({"c": c, "shared": np.bincount(of, shared, len(c)).astype(np.int64)})


def _rows(k: int, wanted) -> Callable:
    """Shingles and sketches of the rows that the table of ``wanted`` hashes lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(known(wanted.value, batch["g"].to_numpy().view(np.uint64)))))
            for lo, hi in slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                token, first = shingles(part["text"], k)
                sketches = [sketch(token[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["g"], part["doc_id"], part["_k"], pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(token.view(np.int64)))],
                    ["g", "doc_id", "_k", "sketch", "columns"],
                )

    return run


def sketch(token: np.ndarray) -> bytes:
    """Which of ``SKETCH_BITS`` slots hold a shingle. A slot that one set has and another lacks is at
    least one shingle that they do not share."""
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[((token * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS] = 1
    return np.packbits(bits).tobytes()


def least_overlap(n: Column, similar: int) -> Column:
    """Fewest shared shingles of a set of ``n`` that has a partner: ceil(n * similar / 100)."""
    return F.floor((n * similar + 99) / 100).cast("long")


def _sizes_fit(a: Column, b: Column, similar: int) -> Column:
    return (a * 100 >= b * similar) & (b * 100 >= a * similar)


def _pair_overlap(a: Column, b: Column, similar: int) -> Column:
    """Fewest shared shingles of a linked pair: ceil(similar * (a + b) / (100 + similar))."""
    return F.ceil((a + b) * similar / F.lit(float(100 + similar)) - 1e-9)


def _may_link(similar: int) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the rows of different components that meet in a shingle and may share enough:
    by size, by how many shingles stand from this one on, and by their sketches."""

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n, root, room = (t[x].to_numpy() for x in ("n", "root", "room"))
        bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(n), -1)

        def near(i: int, o: np.ndarray) -> np.ndarray:
            need = -(-similar * (n[i] + n[o]) // (100 + similar))
            ok = (root[o] != root[i]) & (100 * np.minimum(n[o], n[i]) >= similar * np.maximum(n[o], n[i])) & (np.minimum(room[o], room[i]) >= need)
            at = np.flatnonzero(ok)
            both = np.bitwise_count(bits[o[at]] & bits[i]).sum(1, dtype=np.int64)
            size = np.bitwise_count(bits[o[at]]).sum(1, dtype=np.int64)
            # Slots of one that the other lacks.
            ok[at] = np.minimum(n[i] - (np.bitwise_count(bits[i]).sum(dtype=np.int64) - both), n[o[at]] - (size - both)) >= need[at]
            return ok

        return forest(len(n), near)

    return compare


def _links_inside(groups: DataFrame, rows: DataFrame, similar: int) -> DataFrame:
    """``a, b``: links that connect what is linked inside each group (``c, root``), by exact products."""
    sized = groups.join(rows.select("c", "n"), "c")
    blocks = F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))).cast("long").alias("blocks")
    placed = groups.join(sized.groupBy("root").agg(blocks), "root").join(rows.select("c", F.col("columns").alias("tokens")), "c")
    return by_cell(deal(placed, "root", "c", F.col("blocks")), linked_sets(similar), ["c", "tokens"])


def candidates(docs: DataFrame, sets: DataFrame, stage: Staging, k: int, similar: int, block_columns: int) -> DataFrame:
    """``c, n, blocks``, one row per distinct set that may have a partner: its shingles by column block."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, total / block_columns)))))
    shared = (
        docs.select("text")
        .where("text IS NOT NULL")
        .mapInArrow(_column_blocks(k, bits), "block int, sets binary, sizes binary, columns binary")
        .groupBy("block")
        .applyInArrow(_count_block(bits), "part int, sets binary, shared binary")
        .groupBy("part")
        .applyInArrow(_add_up, "c long, shared long")
    )
    one = sets.where("n_shingles > 0").groupBy("c").agg(F.min("n_shingles").alias("n"), F.min(F.struct("doc_id", "_k")).alias("doc"))
    left = stage.write(
        one.join(shared, "c").where(F.col("shared") >= least_overlap(F.col("n"), similar)).select("c", "n", "doc.doc_id", "doc._k"), "left"
    )
    # Texts stay where they are; only rows that stand for a set that may have a partner are moved.
    g = F.xxhash64("doc_id", "_k").alias("g")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_table(left.select(g)))
    keyed = docs.where("text IS NOT NULL").select("doc_id", "text", text_key("text").alias("_k")).select("*", g)
    found = keyed.mapInArrow(_rows(k, wanted), f"g long, doc_id {dict(docs.dtypes)['doc_id']}, _k binary, sketch binary, columns array<long>").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d._k") == F.col("l._k"))
    both = found.join(left.select("*", g).alias("l"), F.col("d.g") == F.col("l.g"))
    # Rows that repeat an id and a text are one. They lie by g as the join left them, so shingles move once.
    one_of = F.first(F.when(same, F.struct("sketch", "columns")), ignorenulls=True).alias("x")
    return both.groupBy("d.g", "c", "n").agg(one_of).where("x IS NOT NULL").select("c", "n", "x.*")


def _postings(rows: DataFrame, stage: Staging, similar: int) -> DataFrame:
    """Rare parts: ``token, c, n, room, mean`` where ``room`` is how many shared shingles stand from this
    one on, and ``mean`` is how many sets have a shingle of this one, on average."""
    cells = rows.select("c", "n", F.explode("columns").alias("token"))
    often = cells.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = cells.join(often, "token").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"), F.avg("df").alias("mean"))
    m, need = F.size("t"), least_overlap(F.col("n"), similar)
    rare = ordered.where(m >= need).select("c", "n", "mean", m.alias("m"), F.posexplode(F.slice("t", F.lit(1), (m - need + 1).cast("int"))).alias("i", "x"))
    return stage.write(rare.select("x.token", "c", "n", (F.col("m") - F.col("i")).cast("long").alias("room"), "mean"), "postings")


def link_components(docs: DataFrame, stage: Staging, k: int = SHINGLE, similar: int = SIMILAR, block_columns: int = BLOCK_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Sets of all rows of ``docs`` (``doc_id, _k, n_shingles, c``) and ``node, root`` of linked sets."""
    id_type = dict(docs.dtypes)["doc_id"]
    sets = stage.write(
        docs.select("doc_id", "text", text_key("text").alias("_k")).mapInArrow(_measure(k), f"doc_id {id_type}, _k binary, n_shingles long, c long"), "sets"
    )
    rows = stage.write(candidates(docs, sets, stage, k, similar, block_columns), "rows")
    postings = _postings(rows, stage, similar)
    # The most central row of each shingle, and of those that a row meets, the one it meets most often.
    centres = postings.groupBy("token").agg(F.max(F.struct("mean", "c", "n", "room")).alias("m"))
    fit = _sizes_fit(F.col("n"), F.col("m.n"), similar) & (F.least("room", "m.room") >= _pair_overlap(F.col("n"), F.col("m.n"), similar))
    meets = postings.join(centres, "token").where((F.col("c") != F.col("m.c")) & fit).groupBy("c", F.col("m.c").alias("root")).agg(F.count(F.lit(1)).alias("s"))
    best = stage.write(meets.groupBy("c").agg(F.max(F.struct("s", "root")).alias("x")).select("c", "x.root"), "best")
    places = best.unionByName(best.select(F.col("root").alias("c"), "root").distinct())
    links = stage.write(_links_inside(places, rows, similar), "links1")
    roots = stage.write(components(links, stage, "roots1"), "roots1")
    # Shingles in which different components still meet.
    now = postings.drop("mean").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    now = stage.write(now, "now")
    split = now.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("token", "size")
    apart = now.join(split, "token").join(rows.select("c", "sketch"), "c")
    n_blocks = F.ceil(F.col("size") / F.lit(float(BLOCK_MEMBERS))).cast("long")
    near = by_cell(deal(apart, "token", "c", n_blocks), _may_link(similar), ["c", "n", "root", "room", "sketch"])
    groups = components(near, stage, "groups")
    members = stage.write(groups.select(F.col("node").alias("c"), "root").unionByName(groups.select(F.col("root").alias("c"), "root").distinct()), "members")
    more = stage.write(_links_inside(members, rows, similar), "links2")
    if not more.isEmpty():
        roots = stage.write(components(links.unionByName(more), stage, "roots2"), "roots2")
    return sets, roots


def _with_class(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``sets`` with ``root``, the number of the row's class; null where the row has no shingle."""
    return sets.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "c")))


def component_report(docs: DataFrame, stage: Staging, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id`` (least ``doc_id`` of the class).

    Rows without a word are classes of their own: their ``component_id`` is their ``doc_id``. Rows with a
    null ``doc_id`` link like others and get the least id of their class, null if it has none.
    Copies are one document until the end, so a group of copies costs its rows and no pairs.
    Shingles are 64-bit hashes.
    """
    sets, roots = link_components(docs, stage, k, similar)
    rows = stage.write(_with_class(sets, roots), "classes")
    least = stage.write(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, stage: Staging, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Rows of ``docs`` with all but one of each class gone: the least (``doc_id``, text) stays, nulls last,
    and of rows that agree in both any one. Rows without a word stay."""
    sets, roots = link_components(docs, stage, k, similar)
    rows = stage.write(_with_class(sets, roots), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_k"))
    kept = rows.where("root IS NOT NULL").groupBy("root").agg(first.alias("x"), F.count(F.lit(1)).alias("size"))
    # Rows to look at closer: those of classes of several rows. Others are not moved.
    several = kept.where("size > 1").select("root", F.col("x.doc_id").alias("_first"), F.col("x._k").alias("_first_k"))
    gone = stage.write(
        rows.join(several, "root")
        .groupBy("doc_id", "_k")
        .agg(F.max(F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_k") == F.col("_first_k"))).alias("stays"))
        .select(F.struct(F.col("doc_id").alias("id"), F.col("_k").alias("key"), "stays").alias("gone")),
        "gone",
    )
    # The caller's row is one struct, so its columns may have any names.
    x = F.col("gone")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = row.join(gone, F.col("row.doc_id").eqNullSafe(x["id"]) & (text_key(F.col("row.text")) == x["key"]), "left")
    single = joined.where(x.isNull()).select("row.*")
    firsts = joined.where(x["stays"]).dropDuplicates(["gone"]).select("row.*")
    return single.unionByName(firsts)
