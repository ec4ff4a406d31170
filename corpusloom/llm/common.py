"""Shared pieces: working tables in the shared folder, Arrow batches in bounded slices, word hashing in numpy.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D. All separators are single ASCII bytes, so UTF-8
text can be cut on bytes without decoding it.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import working_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Text that one numpy slice holds at most, unless a single document is longer.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, for sessions with Spark's own bound of 64 MB.
BATCH_BYTES = f"{4 << 20}b"
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, unless the session says otherwise: a worker and the JVM hold a batch or two each, and
    rows here may be texts or packed arrays."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)


def written(df: DataFrame, what: str = "t", compression: str = "snappy") -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends here and a lost executor costs nothing. It stays until
    forget(), or until session.clear_working() for all, as rows that were returned may still be read from it."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{working_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(table._corpusloom_path)
    path.getFileSystem(conf).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps. It does so when the driver's collector finds that their
    owners are gone, which on a driver with little to do may be long after; so the collector is asked to run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(schema: str, df: DataFrame, key: str) -> str:
    """The schema, which begins with a long doc_id, with the type that the key of df has."""
    return schema.replace("doc_id long", f"doc_id {df.schema[key].dataType.simpleString()}", 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def parts_for(spark: SparkSession, least: int = 16) -> int:
    """Shuffle partitions of the session, as the number of buckets for exchanges by hash."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Words of up to so many bytes are hashed by table, longer ones one by one.
TABLE_BYTES = 64
#: For each of two independent hashes a number for every byte at every place.
_TABLES = [mix(np.arange(TABLE_BYTES * 256, dtype=np.uint64) + np.uint64(seed << 32)) for seed in (1, 2)]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each; one row at least."""
    offsets = offsets_of(texts)
    begin, n = 0, len(texts)
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
        end = min(n, max(end, begin + 1))
        yield begin, end
        begin = end


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    buf = texts.buffers()[1]
    if buf is None:
        return np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(buf, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Words:
    """Words of a slice of texts: byte ranges in `data`, `first[i]:first[i + 1]` are the words of row i.

    Nulls have to be replaced by empty strings before.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets = offsets_of(texts)
        buf = texts.buffers()[2]
        low, high = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(buf, np.uint8)[low:high] if buf is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        if lower:
            self.data = _LOWER[self.data]
        inside = ~_SEP[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self._inside = inside

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, the same on every machine; `which` is 0 or 1, and the two are independent.

        A word of up to TABLE_BYTES bytes has the sum of random numbers, one for each byte and its place, a longer one
        BLAKE2b's digest. So whatever the words are, two of them agree by chance alone.
        """
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        at = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1], out=at[1:])
        where = np.arange(int(length.sum())) - np.repeat(at, length)
        long = np.flatnonzero(length > TABLE_BYTES)
        if len(long):
            np.minimum(where, TABLE_BYTES - 1, out=where)
        where <<= 8
        where += self.data[self._inside]
        with np.errstate(over="ignore"):
            out = mix(np.add.reduceat(_TABLES[which][where], at) + length.astype(np.uint64))
        for i in long.tolist():
            word = self.data[self.start[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, person=b"%d" % which).digest(), "little")
        return out

    def kept_text(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The words of a row, or those where keep holds, joined by one space."""
        lo, hi = int(self.first[row]), int(self.first[row + 1])
        raw = self.data[int(self.offsets[row]) : int(self.offsets[row + 1])].tobytes()
        words = raw.split()
        assert len(words) == hi - lo
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep, strict=True) if k])


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every window of `width` successive values; shorter by width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(np.arange(width, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
    with np.errstate(over="ignore"):
        total = hashes[:n] * factors[0]
        for j in range(1, width):
            total += hashes[j : n + j] * factors[j]
    return mix(total)


def sql_words(text: str) -> str:
    """SQL of the words of documents, one a row: (doc_id, word, i, n_words)."""
    return rf"""SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n_words
      FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents)"""


def sql_window(width: int) -> str:
    """SQL of the words of the window that begins at a row, null at the end of a text; `doc` is the window clause."""
    return " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER doc" for k in range(1, width))])
