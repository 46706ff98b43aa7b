"""Minimum-cost repair of chat turns, and rendering.

A legal conversation is an optional system turn, then user and assistant in turn, and ends
with an assistant. Every turn is placed as it is, relabelled, or merged into the turn before
it; empty turns may be inserted. A dynamic program over the states of that automaton finds
the cheapest repair. Costs of a run of turns are a matrix from state to state, and matrices
combine, so conversations are cut into bounded runs, combined level by level, and
solved backwards: no task holds a whole conversation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.plans.staging import Staging

#: States are the role of the last turn.
ROLES = ("start", "system", "user", "assistant")
_LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, INSERT = 1.0, 1.5, 2.0
#: Bits of a run's length in turns, and of how many runs one level combines.
RUN_BITS = 8
_FAR = 1e18


def _inserts() -> np.ndarray:
    """Cheapest number of empty turns from state to state; only user and assistant are inserted."""
    n = np.full((4, 4), np.inf)
    for s in range(4):
        n[s, s] = 0
        at, steps = {s}, 0
        while at:
            steps += 1
            at = {t for a in at for t in _LEGAL[a] if t > 1 and n[s, t] == np.inf}
            for t in at:
                n[s, t] = steps
    return n


_INSERTS = _inserts()


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Per role, state before and state after: cost, and choice (state that the turn follows after
    inserts, or -1 for a merge). Of equal costs placing with the fewest inserts comes first."""
    cost, choice = np.full((4, 4, 4), _FAR), np.zeros((4, 4, 4), np.int64)
    for role in range(4):  # 0 stands for a role that is none of the three
        for s in range(4):
            for after in (1, 2, 3):
                relabel = 0.0 if role == after else RELABEL
                options = [(INSERT * _INSERTS[s, t] + relabel, _INSERTS[s, t], t) for t in range(4) if after in _LEGAL[t] and _INSERTS[s, t] < np.inf]
                if s == after:
                    options.append((MERGE + relabel, 9, -1))
                if options:
                    best = min(options)
                    cost[role, s, after], choice[role, s, after] = best[0], best[2]
    return cost, choice


_COST, _CHOICE = _steps()
#: Cost of ending in a state.
_END = np.array([0.0, *[INSERT * _INSERTS[s, 3] for s in (1, 2, 3)]])


def role_number(role: str | None) -> int:
    """Roles are matched without regard to case and blanks around."""
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else 0


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0.0, _FAR)
    for m in matrices:
        out = np.minimum((out[:, :, None] + m[None]).min(1), _FAR)
    return out


def cheapest_path(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """States after each matrix on the cheapest way; of equal ways the smaller last states win."""
    values = [np.full(4, _FAR)]
    values[0][start] = 0.0
    for m in matrices:
        values.append((values[-1][:, None] + m).min(0))
    states = [end]
    for m, v in zip(matrices[:0:-1], values[-2:0:-1], strict=True):
        states.append(int((v + m[:, states[-1]]).argmin()))
    return states[::-1]


def turn_pieces(roles: list[int], texts: list[str | None], start: int, end: int, last: bool) -> list[tuple[str, str, str]]:
    """Per turn: what is done, its role now, and its part of the rendered conversation."""
    out, state = [], start
    path = cheapest_path([_COST[r] for r in roles], start, end)
    for i, (role, text, after) in enumerate(zip(roles, texts, path, strict=True)):
        follows = int(_CHOICE[role, state, after])
        done = [] if role == after else ["relabel"]
        if follows < 0:
            done.append("merge")
            piece = "\n" + (text or "")
        else:
            piece = "" if state == 0 else "<|end|>\n"
            s = state
            while s != follows:
                s = next(t for t in _LEGAL[s] if t > 1)
                done.append("insert")
                piece += f"<|{ROLES[s]}|>\n<|end|>\n"
            piece += f"<|{ROLES[after]}|>\n{text or ''}"
        if last and i == len(roles) - 1:
            piece += "<|end|>\n"
            s = after
            while s != 3:
                s = next(t for t in _LEGAL[s] if t > 1)
                done.append("insert")
                piece += f"<|{ROLES[s]}|>\n<|end|>\n"
        out.append(("+".join(done) or "keep", ROLES[after], piece))
        state = after
    return out


_COSTS = T.ArrayType(T.DoubleType())
_PIECES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("done", "new_role", "piece")]))


@F.pandas_udf(_COSTS)
def _run_costs(roles: pd.Series) -> pd.Series:
    return pd.Series([product([_COST[role_number(r)] for r in rs]).ravel() for rs in roles])


@F.pandas_udf(_COSTS)
def _combined(costs: pd.Series) -> pd.Series:
    return pd.Series([product([np.asarray(m).reshape(4, 4) for m in ms]).ravel() for ms in costs])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _states(costs: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([cheapest_path([np.asarray(m).reshape(4, 4) for m in ms], s, e) for ms, s, e in zip(costs, start, end, strict=True)])


@F.pandas_udf(_PIECES)
def _pieces(roles: pd.Series, texts: pd.Series, start: pd.Series, end: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([[{"done": d, "new_role": r, "piece": p} for d, r, p in turn_pieces([role_number(x) for x in rs], list(ts), s, e, z)] for rs, ts, s, e, z in zip(roles, texts, start, end, last, strict=True)])


def repair(turns: DataFrame, stage: Staging) -> DataFrame:
    """``conv_id, turn, role, done, new_role, piece, order`` per row of ``turns``.

    Turns stand by ``turn`` (nulls last), then role and text; rows with a null ``conv_id`` are one
    conversation, repeated rows are turns of their own, and a null text is empty. A role that is
    none of system, user and assistant counts as relabelled. ``done`` joins what happened to the
    turn and just before it (``insert``), or after the last one, by ``+``. The conversation's
    text is its pieces in ``order``. An empty table gives no rows.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    # Range partitions in order: the running number is the order of the whole table, and a long
    # conversation spreads over several partitions.
    ordered = stage.write(
        turns.select("conv_id", "turn", "role", "text").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("order", F.monotonically_increasing_id()), "ordered"
    )
    # A conversation is a number that is never null: its first place in the order.
    first = ordered.groupBy("conv_id").agg(F.min("order").alias("conv"))
    rows = ordered.alias("o").join(first.alias("f"), F.col("o.conv_id").eqNullSafe(F.col("f.conv_id"))).select("o.*", "conv")
    runs = stage.write(
        rows.groupBy("conv", F.shiftright("order", RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list(F.struct("order", "conv_id", "turn", "role", "text"))).alias("turns")), "runs"
    )
    levels = [stage.write(runs.select("conv", "run", _run_costs(F.transform("turns", lambda t: t["role"])).alias("cost")), "level0")]
    while not levels[-1].groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        up = (
            levels[-1].groupBy("conv", F.shiftright("run", RUN_BITS).alias("up"))
            .agg(F.sort_array(F.collect_list(F.struct("run", "cost"))).alias("runs"))
        )
        costs = _combined(F.transform("runs", lambda x: x["cost"]))
        levels.append(stage.write(up.select("conv", F.col("up").alias("run"), costs.alias("cost"), "runs"), f"level{len(levels)}"))
    # From the whole conversation back to its runs: the state before and after each.
    whole = F.zip_with(F.slice("cost", 1, 4), F.array(*map(F.lit, _END.tolist())), lambda c, e: c + e)
    end = (F.array_position(whole, F.array_min(whole)) - 1).cast("int")
    known = levels[-1].select("conv", "run", F.lit(0).alias("start"), end.alias("end"), F.lit(True).alias("last"))
    for i in range(len(levels) - 1, 0, -1):
        inner = levels[i].join(known, ["conv", "run"]).withColumn("states", _states(F.transform("runs", lambda x: x["cost"]), "start", "end"))
        n = F.size("runs")
        parts = inner.select("conv", "start", "last", "states", n.alias("n"), F.posexplode(F.transform("runs", lambda x: x["run"])).alias("i", "run"))
        before = F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("states", F.col("i") - 1))
        known = stage.write(parts.select("conv", "run", before.alias("start"), F.get("states", F.col("i")).alias("end"), (F.col("last") & (F.col("i") == F.col("n") - 1)).alias("last")), f"known{i}")
    solved = runs.join(known, ["conv", "run"]).select(
        "turns", _pieces(F.transform("turns", lambda t: t["role"]), F.transform("turns", lambda t: t["text"]), "start", "end", "last").alias("pieces")
    )
    return solved.select(F.explode(F.arrays_zip("turns", "pieces")).alias("x")).select(
        "x.turns.conv_id", "x.turns.turn", "x.turns.role", "x.pieces.done", "x.pieces.new_role", "x.pieces.piece", "x.turns.order"
    )
