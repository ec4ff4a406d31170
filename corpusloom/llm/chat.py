"""Chat formatting: minimum-cost repair of the roles of a conversation, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. A row of the input may be taken as a turn with its own role, be given another role, be merged into the
turn before it, or have an empty turn inserted before it; empty turns may be added at the end. Dynamic programming
over the last role finds the cheapest legal sequence, and of equal ones the first in the order of `_options`.

Rows are sorted over all partitions, and a conversation may reach over several of them. A partition solves its first
and last conversation for every pair of roles at its borders and every row keeps the decision for each pair; costs of
such segments are then combined in order, a few numbers per partition, and pick the pair. So no task needs all rows of
one conversation.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import column, parquet, written

ROLES = ["", "system", "user", "assistant"]
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE_SAME, MERGE_OTHER, RELABEL, INSERT = 1, 3, 2, 2
FAR = 1 << 40
MERGED, TURN, INSERTED = range(3)


@functools.cache
def _options(state: int, role: int) -> list[tuple[int, int, int]]:
    """(cost, new state, decision); a decision is kind * 16 + inserted role * 4 + role of the turn."""
    out = []
    if state != NONE:
        out.append((MERGE_SAME if state == role else MERGE_OTHER, state, MERGED * 16 + state))
    for x in NEXT[state]:
        out.append((RELABEL * (x != role), x, TURN * 16 + x))
        for y in NEXT[x]:
            out.append((INSERT + RELABEL * (y != role), y, INSERTED * 16 + x * 4 + y))
    return out


#: Cost of the empty turns that follow the last role.
CLOSING = {NONE: FAR, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}


def solve(roles: list[int], start: int) -> tuple[list[int], list[list[int]]]:
    """From a last role before the rows: the cost for each last role after them, and the decisions to get there."""
    cost, back = [FAR] * 4, []
    cost[start] = 0
    for role in roles:
        new, step = [FAR] * 4, [(0, 0)] * 4
        for state in range(4):
            if cost[state] < FAR:
                for c, to, decision in _options(state, role):
                    if cost[state] + c < new[to]:
                        new[to], step[to] = cost[state] + c, (state, decision)
        cost = new
        back.append(step)
    paths = []
    for end in range(4):
        path, at = [], end
        if cost[end] < FAR:
            for step in reversed(back):
                at, decision = step[at]
                path.append(decision)
        paths.append(path[::-1] or [0] * len(roles))
    return cost, paths


def _segment(conv, roles: list[int], part: int, first: bool, last: bool) -> tuple[list[bytes], dict | None]:
    if not first and not last:
        cost, paths = solve(roles, NONE)
        end = min(range(4), key=lambda e: cost[e] + CLOSING[e])
        return [bytes([d]) for d in paths[end]], None
    solved = [solve(roles, s) for s in range(4)]
    rows = [bytes(solved[s][1][e][i] for s in range(4) for e in range(4)) for i in range(len(roles))]
    return rows, {"conv_id": conv, "part": part, "costs": [c for cost, _ in solved for c in cost]}


ROWS = "conv_id long, turn long, role string, text string, part int, nth long, decisions binary, costs array<long>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth = TaskContext.get().partitionId(), 0
    kept: list[tuple] = []
    first = True

    def flush(last: bool) -> pa.RecordBatch:
        nonlocal nth, first
        codes = [ROLES.index(r) if r in ROLES else NONE for r in ((x[2] or "").strip().lower() for x in kept)]
        decisions, segment = _segment(kept[0][0], codes, part, first, last)
        costs = [None] * (len(kept) - 1) + [segment["costs"] if segment else None]
        n = len(kept)
        cols = list(zip(*kept, strict=True))
        out = pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array([part] * n, pa.int32()), pa.array(range(nth, nth + n), pa.int64()), pa.array(decisions, pa.binary()), pa.array(costs, pa.list_(pa.int64()))], [c.split()[0] for c in ROWS.split(", ")])
        nth, first = nth + n, False
        kept.clear()
        return out

    for batch in batches:
        done = []
        for row in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if kept and kept[0][0] != row[0]:
                done.append(flush(last=False))
            kept.append(row)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if kept:
        yield flush(last=True)


def _joined(key, pdf):
    """The border roles of the segments of one conversation, from their costs in order."""
    pdf = pdf.sort_values("part")
    best, back = [0, FAR, FAR, FAR], []
    for costs in pdf["costs"]:
        step = [min(range(4), key=lambda s, e=e: (best[s] + costs[s * 4 + e], s)) for e in range(4)]
        best = [min(FAR, best[step[e]] + costs[step[e] * 4 + e]) for e in range(4)]
        back.append(step)
    end = min(range(4), key=lambda e: best[e] + CLOSING[e])
    pairs = []
    for step in reversed(back):
        pairs.append(step[end] * 4 + end)
        end = step[end]
    return pd.DataFrame({"conv": pdf["conv_id"].astype("Int64"), "part": pdf["part"], "pair": pairs[::-1], "final": [False] * (len(pdf) - 1) + [True]})


def repair_roles(df: DataFrame) -> DataFrame:
    """One row per row of the input, in place: (conv_id, part, nth, turn, role, text, kind, inserted, new_role, closing).

    `kind` is merged, turn or inserted; `inserted` is the role of an empty turn before this one, `closing` the empty
    turns that follow the last row. Order is by turn, then role, then text; nulls come first, repeated rows stay. A
    role is taken without case and outer blanks; unknown and null roles cost a relabel or a merge wherever they go.
    Rows with a null conv_id form one conversation. A null text is an empty one. An empty table gives no rows. Other
    columns than conv_id, turn, role and text are not looked at, whatever their names.
    """
    own = df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("id", F.monotonically_increasing_id())
    own = own.repartitionByRange("conv_id", "turn", "role", "text", "id").sortWithinPartitions("conv_id", "turn", "role", "text", "id")
    rows = written(own.select("conv_id", "turn", "role", "text").mapInArrow(_solved, ROWS), "turns")
    pairs = rows.where("costs IS NOT NULL").select("conv_id", "part", "costs").groupBy("conv_id").applyInPandas(_joined, "conv long, part int, pair int, final boolean")
    rows = rows.join(pairs, F.col("conv_id").eqNullSafe(F.col("conv")) & (rows["part"] == pairs["part"]), "left").drop(pairs["part"])
    # A conversation within one partition has one decision per row.
    decision = F.conv(F.hex(F.expr("substring(decisions, coalesce(pair, 0) + 1, 1)")), 16, 10).cast("int")
    name = lambda c: F.element_at(F.lit(ROLES), c + 1)
    rows = rows.withColumn("d", decision).withColumn("x", F.col("d") % 4)
    last = F.lead("nth").over(_within()).isNull() & F.coalesce("final", F.lit(True))
    return rows.withColumn("is_last", last).select(
        "conv_id", "part", "nth", "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
        F.element_at(F.lit(["merged", "turn", "inserted"]), F.floor(F.col("d") / 16).cast("int") + 1).alias("kind"),
        F.when(F.col("d") >= 32, name((F.floor(F.col("d") / 4) % 4).cast("int"))).alias("inserted"),
        name(F.col("x")).alias("new_role"),
        F.when(F.col("is_last") & (F.col("x") == SYSTEM), F.lit(["user", "assistant"])).when(F.col("is_last") & (F.col("x") == USER), F.lit(["assistant"])).otherwise(F.array().cast("array<string>")).alias("closing"),
    )


def _within():
    from pyspark.sql.window import Window

    return Window.partitionBy("conv_id", "part").orderBy("nth")


def rendered(repaired: DataFrame, head: str = "<|", tail: str = "|>\n", end: str = "\n") -> DataFrame:
    """Adds `fragment`: the pieces of a conversation in order of (part, nth), put together, are its rendered form.

    Merged rows follow a line end. Fragments rather than whole texts, since one conversation may be of any size.
    """
    turn = lambda role: F.concat(F.lit(head), role, F.lit(tail))
    before = F.when(F.col("kind") == "merged", F.lit("\n")).otherwise(F.concat(F.coalesce(F.concat(turn(F.col("inserted")), F.lit(end)), F.lit("")), turn(F.col("new_role"))))
    after = F.array_join(F.transform("closing", lambda r: F.concat(F.lit(end), turn(r))), "")
    return repaired.withColumn("fragment", F.concat(F.when((F.col("kind") != "merged") & (F.lag("nth").over(_within()).isNotNull()), F.lit(end)).otherwise(F.lit("")), before, "text", after))


def op2_chat_format(spark, sf_dir):
    out = rendered(repair_roles(parquet(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "kind", "inserted", "new_role", F.size("closing").alias("n_closing"), F.sha2("fragment", 256).alias("fragment_sha256"))


QUERIES = {"op2_chat_format": op2_chat_format}
SQL: dict[str, str] = {}
