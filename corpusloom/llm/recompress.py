"""Substring dedup by recompression: words of later copies of long repeats go.

A text is a sequence of symbols, words at first. A round names its runs (maximal stretches of one symbol, by symbol and
length) and then its pairs: by a bit of its name a symbol is left or right, and a left one followed by a right one
becomes one symbol. A name is a hash of what it stands for and of the round, so all machines give the same name to the
same run or pair without asking each other, and equal passages get equal symbols but for a few at either end. Rounds go on
until a text is one symbol.

- *Whole texts.* Texts with the same last symbol, and with the same SHA-256 of their words, are copies; all words of those
  with a larger key than the smallest go, and only one of them has part in what follows.
- *Windows.* What a window of `width` words fixes of a round, whatever stands around it, is its core: of the core of the
  round before, the outer runs go, as they may reach out, and then an outer symbol that may pair with one outside. The
  last round, of the few that suit the width, with a core that is not empty gives the window's symbol: of that core the one with the smallest name, taken
  with as many words to either side as rounds were made; so many have been cut off. A window without any such round is its
  own symbol. Equal windows have equal symbols, and neighbouring windows mostly have the same.
- Symbols are counted over all documents. Windows whose symbol only one text has are done. The others are compared: those
  with equal hashes of 96 bits are one window, and one that starts in a document with a smaller key goes. 64 of the bits
  come from one hash of the words and 32 from an independent one.

Symbols are exchanged in packed arrays, a symbol once per chunk of about 32 MB of text, windows as rows of plain joins and
aggregates: partial sums go before each shuffle and no group is ever held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Words, column, forget, mix, parquet, parts_for, settle, slices, sql_window, sql_words, windows, written
from corpusloom.llm.exchange import blobs, bucket_edges, buckets_for, i64, key_filter, u64

WIDTH = 13
#: Text of which each symbol is sent once.
CHUNK_BYTES = 32 << 20
#: Tasks that the copies of one text are dealt over.
SALTS = 16
#: Rounds after which the symbols that are left of a text are named as one sequence.
MOST_ROUNDS = 300
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B, _C = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


class Round:
    """One round over symbols with names; `fresh` marks those that begin a text, `start` the words at which they begin."""

    def __init__(self, names: np.ndarray, start: np.ndarray, fresh: np.ndarray, level: int):
        new = fresh.copy()
        new[1:] |= names[1:] != names[:-1]
        heads = np.flatnonzero(new)
        length = np.diff(np.append(heads, len(names)))
        runs, many = names[heads], length > 1
        with np.errstate(over="ignore"):
            runs[many] = mix(runs[many] * _A + length[many].astype(np.uint64) * _C + np.uint64(2 * level))
            self.left = (mix(runs ^ np.uint64(level + 1)) >> np.uint64(17)) & np.uint64(1) == 1
            joins = np.zeros(len(runs), bool)
            joins[1:] = self.left[:-1] & ~self.left[1:] & ~fresh[heads[1:]]
            first = np.flatnonzero(joins) - 1
            runs[first] = mix(runs[first] * _A + runs[first + 1] * _B + np.uint64(2 * level + 1))
        #: Symbol -> its run, run -> its symbol of the next round.
        self.run, self.pair = np.cumsum(new) - 1, np.cumsum(~joins) - 1
        self.names, self.start, self.fresh = runs[~joins], start[heads][~joins], fresh[heads][~joins]

    def core(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of cores low:high of the symbols before, those of this round; empty where low >= high."""
        last = len(self.left) - 1
        low, high = self.run[low] + 1, self.run[high - 1]
        low = low + ~self.left[np.minimum(low, last)]
        high = high - self.left[high - 1]
        full = low < high
        return np.where(full, self.pair[np.minimum(low, last)], 1), np.where(full, self.pair[np.maximum(high - 1, 0)] + 1, 0)


def rounds_for(width: int) -> int:
    """Rounds after which a core still has three symbols or so: of longer cores fewer windows in a row have the same
    smallest one, of shorter ones they share less. A round cuts off three symbols and leaves three quarters."""
    rounds, left = 0, (width - 3) * 0.75
    while left >= 3:
        rounds, left = rounds + 1, (left - 3) * 0.75
    return max(rounds, 1)


def _named(names: np.ndarray, start: np.ndarray, hashes: np.ndarray, level: int) -> np.ndarray:
    """Symbols with `level` words to either side; meaningless at the ends of texts, where no core reaches."""
    around = windows(hashes, level, 5)
    end = np.append(start[1:], len(hashes))
    before, after = np.clip(start - level, 0, len(around) - 1), np.clip(end, 0, len(around) - 1)
    with np.errstate(over="ignore"):
        return mix(names * _A + around[before] * _B + around[after] * _C)


def symbols(hashes: np.ndarray, first: np.ndarray, width: int = WIDTH, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For every word the symbol of the window that begins there, NONE where none does; and the last symbol of each text.

    `hashes` are the words of texts that begin at the words `first`. Texts without words, and all texts unless `whole`,
    have the last symbol 0.
    """
    n = len(hashes)
    out, tops = np.full(n, NONE, np.uint64), np.zeros(len(first), np.uint64)
    if not n:
        return out, tops
    ends = np.append(first[1:], n)
    at = np.flatnonzero(np.arange(n) + width <= np.repeat(ends, ends - first))
    low, high = at, at + width
    names, start, fresh, level = hashes, np.arange(n), np.zeros(n, bool), 0
    fresh[first[first < ends]] = True
    texts, rounds = int(fresh.sum()), rounds_for(width)
    while len(at) or (whole and len(names) > texts and level < MOST_ROUNDS):
        step = Round(names, start, fresh, level)
        if len(at):
            deeper = step.core(low, high)
            ends_here = (deeper[0] >= deeper[1]) | (level == rounds)
            here, lo, hi = at[ends_here], low[ends_here], high[ends_here]
            if not level:
                out[here] = windows(hashes, width, 11)[here]
            elif len(here):
                value = _named(names, start, hashes, level)
                least = value[lo]
                for k in range(1, int((hi - lo).max())):
                    np.minimum(least, value[np.minimum(lo + k, hi - 1)], out=least)
                out[here] = least
            at, low, high = at[~ends_here], deeper[0][~ends_here], deeper[1][~ends_here]
        names, start, fresh, level = step.names, step.start, step.fresh, level + 1
    # Smallest names are no longer evenly spread; mixed again they are.
    found = np.arange(n) + width <= np.repeat(ends, ends - first)
    out[found] = np.minimum(mix(out[found]), NONE - np.uint64(1))
    if whole:
        heads = np.flatnonzero(fresh)
        with np.errstate(over="ignore"):
            place = np.arange(len(names)) - np.repeat(heads, np.diff(np.append(heads, len(names))))
            tops[first < ends] = mix(np.add.reduceat(mix(names + place.astype(np.uint64) * _C), heads))
    return out, tops


CHUNKS = "b long, docs binary, none binary, ids binary, n_words binary, tops binary, sha binary, n_keys binary, keys binary"


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        cells = [np.concatenate(x).tobytes() for x in zip(*held, strict=True)]
        return pa.record_batch([pa.array([(part << 32) + number], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], [x.split()[0] for x in CHUNKS.split(", ")])

    for batch in batches:
        texts = column(batch, "t").fill_null("")
        for lo, hi in slices(texts):
            words, docs = Words(texts[lo:hi]), column(batch, "k")[lo:hi]
            none = docs.is_null().to_numpy(zero_copy_only=False)
            own, tops = symbols(words.hashes(), words.first[:-1], width)
            keys, sha = [], []
            for i in range(hi - lo):
                x = own[words.first[i] : words.first[i + 1]]
                x = np.unique(x[np.flatnonzero(x[1:] != x[:-1])]) if len(x) > 1 else x
                # The last word begins no window but for a width of 1.
                x = np.unique(np.append(x, own[words.first[i + 1] - 1 : words.first[i + 1]])) if width == 1 else x
                keys.append(x[x != NONE] if not none[i] else x[:0])
                sha.append(hashlib.sha256(words.kept_text(i)).digest())
            ids, n_words = column(batch, "id")[lo:hi].to_numpy(), np.diff(words.first).astype(np.int64)
            held.append((docs.fill_null(0).to_numpy(), none, ids, n_words, tops, np.frombuffer(b"".join(sha), np.uint8), np.array([len(k) for k in keys], np.int64), np.concatenate(keys)))
            size += len(words.data)
            if size >= CHUNK_BYTES:
                yield row()
                number, held, size = number + 1, [], 0
    if held:
        yield row()


DOCS = "k long, id long, n_words long, top long, sha binary"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of the chunks."""
    for batch in batches:
        for row in range(len(batch)):
            docs, ids, n_words, tops = (i64(column(batch, c)[row]) for c in ("docs", "ids", "n_words", "tops"))
            none = np.frombuffer(column(batch, "none")[row].as_buffer(), bool)
            sha = pa.Array.from_buffers(pa.binary(32), len(docs), [None, column(batch, "sha")[row].as_buffer()]).cast(pa.binary())
            yield pa.record_batch([pa.array(docs, mask=none), pa.array(ids), pa.array(n_words), pa.array(tops), sha], ["k", "id", "n_words", "top", "sha"])


def _repeated(table: DataFrame, buckets: int) -> DataFrame:
    """(b, found): for each chunk, its keys that texts with different words have. Texts are told apart by the last symbol and
    the SHA-256 together."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                text = u64(column(batch, "tops")[row]) ^ u64(column(batch, "sha")[row])[::4]
                keys, top = u64(column(batch, "keys")[row]), np.repeat(text, i64(column(batch, "n_keys")[row]))
                order = np.argsort(keys, kind="stable")
                keys, top = keys[order], top[order]
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                heads = np.flatnonzero(new)
                # Keys of which not all are of the text of the first.
                many = np.bincount((np.cumsum(new) - 1)[top != np.repeat(top[heads], np.diff(np.append(heads, len(keys))))], minlength=len(heads)) > 0
                keys, top = keys[heads], top[heads]
                edges = bucket_edges(keys, buckets)
                full = np.flatnonzero(np.diff(edges))
                b = column(batch, "b")[row].as_py()
                yield pa.record_batch([pa.array(full, pa.int64()), pa.array([b] * len(full), pa.int64()), *(blobs(c[edges[i] : edges[i + 1]] for i in full) for c in (keys, top, many))], ["bucket", "b", "keys", "tops", "many"])

    def answer(table: pa.Table) -> pa.Table:
        parts = [u64(k) for k in table.column("keys")]
        top = np.concatenate([u64(t) for t in table.column("tops")])
        many = np.concatenate([np.frombuffer(m.as_buffer(), bool) for m in table.column("many")])
        _, head, which = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        hit = np.zeros(len(head), bool)
        hit[which[many | (top != top[head][which])]] = True
        hit, ends = hit[which], np.cumsum([len(p) for p in parts])
        found = [p[h] for p, h in zip(parts, np.split(hit, ends[:-1]), strict=True)]
        keep = [i for i, f in enumerate(found) if len(f)]
        return pa.table({"b": table.column("b").take(pa.array(keep, pa.int64())), "found": blobs(found[i] for i in keep)})

    sent = table.select("b", "tops", "sha", "n_keys", "keys").mapInArrow(send, "bucket long, b long, keys binary, tops binary, many binary")
    return sent.groupBy("bucket").applyInArrow(answer, "b long, found binary").groupBy("b").agg(F.collect_list("found").alias("found"))


def _actives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with repeated keys: (k, id, keys)."""
    for batch in batches:
        for row in range(len(batch)):
            found = np.sort(np.concatenate([u64(x) for x in column(batch, "found")[row].values]))
            keys = u64(column(batch, "keys")[row])
            hit = found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys
            n_keys = i64(column(batch, "n_keys")[row])
            member = np.repeat(np.arange(len(n_keys)), n_keys)[hit]
            count = np.bincount(member, minlength=len(n_keys))
            keep = np.flatnonzero(count)
            docs, ids, keys = i64(column(batch, "docs")[row]), i64(column(batch, "ids")[row]), keys[hit]
            ends = np.cumsum(count[keep])
            for lo in range(0, len(keep), 2_000):
                hi = min(lo + 2_000, len(keep))
                yield pa.record_batch([pa.array(docs[keep[lo:hi]]), pa.array(ids[keep[lo:hi]]), blobs(keys[ends[i] - count[keep[i]] : ends[i]] for i in range(lo, hi))], ["k", "id", "keys"])


WINDOWS = "k long, id long, at int, high long, low int"


def _windows(width: int):
    """The windows of texts whose symbols are among the repeated ones of the text, with 96-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(column(batch, "t")):
                words = Words(column(batch, "t")[lo:hi])
                hashes, again = words.hashes(), words.hashes(1)
                own, _ = symbols(hashes, words.first[:-1], width, whole=False)
                hit = np.zeros(len(hashes), bool)
                for i, keys in enumerate(column(batch, "keys")[lo:hi]):
                    a, b = words.first[i], words.first[i + 1]
                    known = np.sort(u64(keys))
                    hit[a:b] = known[np.minimum(np.searchsorted(known, own[a:b]), len(known) - 1)] == own[a:b]
                at = np.flatnonzero(hit)
                row = np.searchsorted(words.first, at, "right") - 1
                high, low = (windows(of_words, width, seed)[at] if len(at) else np.zeros(0, np.uint64) for of_words, seed in ((hashes, 17), (again, 13)))
                doc, of = (column(batch, c)[lo:hi].to_numpy()[row] for c in ("k", "id"))
                cells = [doc, of, (at - words.first[row]).astype(np.int32), high.view(np.int64), low.astype(np.uint32).view(np.int32)]
                for i in range(0, len(at), 100_000):
                    yield pa.record_batch([pa.array(c[i : i + 100_000]) for c in cells], [x.split()[0] for x in WINDOWS.split(", ")])

    return run


KEPT = "k long, id long, n_removed long, kept string"


def _cleaned(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(column(batch, "t")):
                words, removed, kept = Words(column(batch, "t")[lo:hi]), [], []
                for i, late in enumerate(column(batch, "late")[lo:hi]):
                    late, n = late.values.to_numpy(), int(words.first[i + 1] - words.first[i])
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, late, 1)
                    np.add.at(step, late + width, -1)
                    gone = np.cumsum(step)[:n] > 0
                    removed.append(int(gone.sum()))
                    kept.append(words.kept_text(i, ~gone))
                yield pa.record_batch([column(batch, "k")[lo:hi], column(batch, "id")[lo:hi], pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["k", "id", "n_removed", "kept"])

    return run


def _texts_of(rows: DataFrame, some: DataFrame, what: str) -> DataFrame:
    """(k, id, t, what) for the documents of some(k, id, what); a fixed filter keeps most other texts out of the shuffle."""
    own = F.xxhash64("k", "id")
    passes = key_filter(some.select(own.alias("h")), "h")
    texts = rows.where(F.col("k").isNotNull()).where(passes(own)).join(some, ["k", "id"])
    return texts.groupBy("k", "id").agg(F.first("t").alias("t"), F.first(what).alias(what))


def changed_texts(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """From rows(k, t, id): (k, id, n_words, top, sha) of all, and (k, id, n_removed, kept) of those that lose words.

    Rows with equal k and text are one document to this, and so are rows with equal k in that none removes words of
    another; a row with a null k is compared with none.
    """
    if width < 1:
        raise ValueError("width is less than 1")
    spark = rows.sparkSession
    table = written(rows.mapInArrow(lambda batches: _chunks(batches, width), CHUNKS), "symbols")
    docs = written(table.select("docs", "none", "ids", "n_words", "tops", "sha").mapInArrow(_documents, DOCS), "docs")
    known = docs.where(F.col("k").isNotNull() & (F.col("n_words") >= width))
    first = known.groupBy("top", "sha", "n_words").agg(F.min("k").alias("low"), F.max("k").alias("last")).where("low < last").drop("last")
    # A text may have any number of copies, so they are dealt over SALTS tasks.
    first = first.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    known = known.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))
    copies = known.join(first, ["top", "sha", "n_words", "salt"]).where("k > low").select("k", "id", "n_words")
    copies = written(copies.distinct(), "copies")
    keys = table.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    found = _repeated(table, buckets_for(keys, parts_for(spark)))
    active = table.select("b", "docs", "ids", "n_keys", "keys").join(found, "b").mapInArrow(_actives, "k long, id long, keys binary")
    active = active.join(copies.select("k", "id"), ["k", "id"], "left_anti")
    active = written(active.groupBy("k", "id").agg(F.first("keys").alias("keys")), "active")
    forget(table)
    settle(spark)
    texts = _texts_of(rows, active, "keys")
    found = written(texts.mapInArrow(_windows(width), WINDOWS), "windows")
    forget(active)
    settle(spark)
    first = found.groupBy("high", "low").agg(F.min("k").alias("least"), F.max("k").alias("last")).where("least < last").drop("last")
    first = written(first, "first")
    settle(spark)
    late = found.join(first, ["high", "low"]).where("k > least").groupBy("k", "id").agg(F.collect_list("at").alias("late"))
    late = written(late, "late")
    forget(found)
    forget(first)
    settle(spark)
    kept = written(_texts_of(rows, late, "late").mapInArrow(_cleaned(width), KEPT), "kept")
    forget(late)
    settle(spark)
    return docs, kept.unionByName(copies.select("k", "id", F.col("n_words").alias("n_removed"), F.lit("").alias("kept")))


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} is not an integer")
    own = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return own.withColumn("id", F.xxhash64("t"))


def removal_report(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for every row.

    A null text has no words. Texts under `width` words lose nothing. Of repeated rows each is reported; they are one
    document, so they don't remove each other. A null key compares with none. An empty table gives no rows. Other columns
    are not looked at. Keys have to be integers, else ValueError is raised.
    """
    docs, kept = changed_texts(_rows(df, key, text), width)
    kept = kept.select(F.col("k").alias("lk"), F.col("id").alias("lid"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha"))
    return docs.join(kept, (F.col("k") == F.col("lk")) & (F.col("id") == F.col("lid")), "left").select(
        F.col("k").alias(key), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", F.lower(F.hex("sha"))).alias("kept_sha256")
    )


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of df, with the kept words joined by one space as the text of those that lose any. A text that loses
    nothing stays as it is. Nulls, repeated rows and keys are as in removal_report()."""
    docs, kept = changed_texts(_rows(df, key, text), width)
    forget(docs)
    kept = kept.select(F.col("k").alias("_loom_k"), F.col("id").alias("_loom_id"), F.col("kept").alias("_loom_kept"))
    own = df.join(kept, (F.col(key) == F.col("_loom_k")) & (F.xxhash64(text) == F.col("_loom_id")), "left")
    return own.select(*(F.coalesce("_loom_kept", F.col(text)).alias(text) if c == text else F.col(c) for c in df.columns))


def op10_substring_dedup(spark, sf_dir):
    return removal_report(parquet(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQL = {
    "op10_substring_dedup": f"""
    WITH words AS ({sql_words("text")}
    ), windows AS (
      SELECT doc_id, i, {sql_window(WIDTH)} AS content FROM words WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
    ), late AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY content) AS least FROM windows WHERE content IS NOT NULL) WHERE least < doc_id
    ), gone AS (
      SELECT DISTINCT doc_id, i + unnest(range({WIDTH})) AS i FROM late
    ), kept AS (
      SELECT doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone.i IS NULL) AS content
      FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(content, '')) AS kept_sha256
    FROM documents LEFT JOIN kept USING (doc_id)"""
}
