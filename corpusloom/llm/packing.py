"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens, in turns of `quantum`. A queue with N turns takes its j-th at the time
(j + phase) / N of its span, with a phase in (0, 1) from a hash of the source, so the many sources with few turns do not
meet at one time. The span of a source with a target share is its total over that share; all others have one span
together, the total of them over the share that is left. So at any moment each queue has had its share of the tokens so
far to within one turn, and what it is short of is carried on, over windows and partitions. A queue that is empty drops
out and the others go on in their proportions. Without targets all spans are the total of all tokens: shares are those of
the corpus.

The order of all parts of documents by time, source and place is total, so a token's position is a running sum of
lengths. Time maps to the expected position, and the parts of some million positions are one cell; cells are sorted
alone, and the sums of cells before are added. Neither the number of sources nor that of a source's tokens matters to any
task. Windows are cut from the order without gaps, so only the last sequence is padded.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.bpe import default_path, id_maker
from corpusloom.llm.common import column, keyed, offsets_of, parquet, slices, written

LENGTH, QUANTUM, END_ID = 2048, 128, 1
#: Tokens of a cell, and cells of which the driver sees the sum only.
CELL, CELL_GROUP = 1 << 20, 1 << 13
TOKENS = "doc_id long, source string, run int, at long, n long, ids binary"
PARTS = "doc_id long, source string, total long, turn long, place long, start long, n long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _binary(buffer: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges between successive ends as values, without a copy of each."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buffer)]).cast(pa.binary())


def _bytes(values: pa.Array) -> np.ndarray:
    ends, data = offsets_of(values), values.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)


def tokenized(df: DataFrame, key: str, text: str, source: str, path: str, end_id: int) -> DataFrame:
    """Tokens of each row (16 bits each, with the end id), and how many of its source came before in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, run_id = id_maker(path).encode, {}, TaskContext.get().partitionId()
        end = np.uint16(end_id).tobytes()
        for batch in batches:
            keys, texts, sources = column(batch, "k"), column(batch, "t").fill_null(""), column(batch, "s").fill_null("")
            for lo, hi in slices(texts):
                ids = [encode(x) + end for x in texts[lo:hi].to_pylist()]
                n, at, own = [len(x) // 2 for x in ids], [], sources[lo:hi]
                for s, m in zip(own.to_pylist(), n, strict=True):
                    at.append(seen.get(s, 0))
                    seen[s] = at[-1] + m
                yield pa.record_batch([keys[lo:hi], own, pa.array([run_id] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], _names(TOKENS))

    return df.selectExpr(f"`{key}` AS k", f"`{text}` AS t", f"`{source}` AS s").mapInArrow(run, keyed(TOKENS, df, key))


def turns_of(place: np.ndarray, n: np.ndarray, quantum: int) -> tuple[np.ndarray, ...]:
    """Row, turn, start in the row and length of the parts of rows that lie at `place` in their queues."""
    first = place // quantum
    count = np.where(n > 0, (place + n - 1) // quantum - first + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    begin = np.maximum(turn * quantum, place[row])
    return row, turn, begin - place[row], np.minimum((turn + 1) * quantum, (place + n)[row]) - begin


def _parts(quantum: int, names: list[str]):
    """The parts of rows by turn: the columns `names` of PARTS, with the ids only if they are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = column(batch, "place").to_numpy(), column(batch, "n").to_numpy()
            row, turn, start, size = turns_of(place, n, quantum)
            own = {"turn": turn, "place": place[row] + start, "start": start, "n": size, "doc_tokens": n[row]}
            if "ids" in names:
                own["ids"] = _binary(_bytes(column(batch, "ids")), np.concatenate([[0], np.cumsum(size) * 2]))
            at = pa.array(row)
            yield pa.record_batch([pa.array(own[c]) if c in own else column(batch, c).take(at) for c in names], names)

    return run


def pieces_of(position: np.ndarray, size: np.ndarray, follows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin in the row and length of pieces: parts that follow on their predecessor join it, windows cut them."""
    ends = np.cumsum(size)
    begins = ends - size
    # Where windows end inside parts; a part is no longer than a window.
    room = length - position % length
    over = room < size
    cuts = np.sort(np.concatenate([begins[~follows | (position % length == 0)], (begins + room)[over]]))
    row = np.searchsorted(begins, cuts, "right") - 1
    return row, cuts - begins[row], np.diff(np.append(cuts, ends[-1] if len(ends) else 0))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            docs = column(batch, "doc_id")
            place, start, size, position, of = (column(batch, c).to_numpy() for c in ("place", "start", "n", "position", "of"))
            follows = np.zeros(len(size), bool)
            follows[1:] = (start[1:] > 0) & (of[1:] == of[:-1])
            for x in (place, start, position):
                follows[1:] &= x[1:] == x[:-1] + size[:-1]
            row, inner, own = pieces_of(position, size, follows, length)
            ids = _bytes(column(batch, "ids")).view(np.uint16).astype("<u4").view(np.uint8)
            at = position[row] + inner
            yield pa.record_batch([docs.take(pa.array(row)), pa.array(start[row] + inner), pa.array(own), _binary(ids, np.concatenate([[0], np.cumsum(own) * 4])), column(batch, "doc_tokens").take(pa.array(row)), pa.array(at // length), pa.array(at % length)], _names(PIECES))

    return run


def spans(targets: Mapping[str, float], totals: Mapping[str, int], tokens: int) -> tuple[dict[str, float], float, float]:
    """(span of each source with a target, span of the others, where theirs begins)."""
    if any(not x > 0 for x in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are not positive shares of one")
    own = {s: totals.get(s, 0) / x for s, x in targets.items()}
    left, rest = 1 - sum(targets.values()), tokens - sum(totals.get(s, 0) for s in targets)
    if left > 1e-9:
        return own, rest / left, 0.0
    return own, float(rest), max(own.values(), default=0.0)  # no share is left for the others: they follow


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None, length: int = LENGTH, quantum: int = QUANTUM, end_id: int = END_ID, targets: Mapping[str, float] | None = None) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    `targets` are shares of the tokens of each window by source; sources without one share what is left in proportion to
    their totals, or follow at the end if nothing is. Without targets all do. A null or empty text has the end id only; a
    null source is the source ''. Repeated rows are packed each; keys may be of any type and null. An empty table gives no rows. Other
    columns of df are not looked at. `length` has to be a multiple of `quantum`. The tokens are kept in one table of the
    shared folder and read again when all totals are known.
    """
    if length % quantum:
        raise ValueError("length is not a multiple of quantum")
    targets = dict(targets or {})
    tokens = written(tokenized(df, key, text, source, path or default_path(), end_id), "tokens")
    runs = tokens.groupBy("run", "source").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("source")
    before = own.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.select("run", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"), "n"), "offsets")
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals = {r[0]: r[1] for r in runs.where(F.col("source").isin(list(targets))).groupBy("source").agg(F.first("total")).collect()} if targets else {}
    span, rest, after = spans(targets, totals, total)

    def when(values: Mapping[str, float], other: float) -> Column:
        out = None
        for s, x in values.items():
            out = (F if out is None else out).when(F.col("source") == s, F.lit(x))
        return F.lit(other) if out is None else out.otherwise(F.lit(other))

    phase = (F.pmod(F.xxhash64("source"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    at = (F.col("turn") + phase) / F.ceil(F.col("total") / quantum)
    time = at * when(span, rest) + when(dict.fromkeys(span, 0.0), after)
    # Tokens that are expected before a time.
    rate = lambda n, s: F.lit(float(n)) * F.least(F.col("time") / s, F.lit(1.0))
    left = total - sum(totals.values())
    expected = sum((rate(totals.get(s, 0), x) for s, x in span.items() if x), F.lit(0.0))
    if left:
        expected = expected + F.lit(float(left)) * F.least(F.greatest(F.col("time") - after, F.lit(0.0)) / rest, F.lit(1.0))
    joined = tokens.join(runs.drop("n"), ["run", "source"]).withColumn("place", F.col("before") + F.col("at"))

    def parts_with(names: list[str]) -> DataFrame:
        schema = keyed(", ".join(x for x in PARTS.split(", ") if x.split()[0] in names), tokens, "doc_id")
        own = joined.select(*(c for c in names if c in joined.columns)).mapInArrow(_parts(quantum, names), schema)
        return own.withColumn("time", time).withColumn("cell", F.floor(expected / CELL).cast("long"))

    cells = _before(parts_with(["source", "total", "turn", "place", "n"]))
    parts = parts_with(_names(PARTS))
    order = Window.partitionBy("cell").orderBy("time", "source", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.drop("total", "turn").withColumn("inner", F.coalesce(F.sum("n").over(order), F.lit(0)))
    placed = placed.join(cells, "cell").select("doc_id", F.xxhash64("source").alias("of"), "place", "start", "n", "doc_tokens", "ids", (F.col("base") + F.col("inner")).alias("position"))
    return placed.mapInArrow(_cut(length), keyed(PIECES, tokens, "doc_id"))


def _before(parts: DataFrame) -> DataFrame:
    """(cell, base): the tokens in the cells before each."""
    sums = written(parts.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("group", F.floor(F.col("cell") / CELL_GROUP).cast("long")), "cells")
    groups, base = sums.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect(), 0  # one row for CELL * CELL_GROUP tokens
    first: dict[int, int] = {}
    for r in groups:
        first[r["group"]] = base
        base += r["n"]
    starts = parts.sparkSession.createDataFrame(list(first.items()), "`group` long, first long")
    inside = Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(starts, "group").select("cell", (F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark, sf_dir):
    return digests(pack(parquet(spark, sf_dir, "documents")))


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
