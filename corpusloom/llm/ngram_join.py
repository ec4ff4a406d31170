"""N-gram Jaccard join with prefix filtering, and the components of its links.

Each distinct set of shingles is one class, represented by a set of 64-bit hashes. Two sets with a Jaccard similarity
of at least t share one of the first n - ceil(t n) + 1 shingles of either, in any one order of all shingles; a shingle
that one class has links nothing. This is used twice.

First, to find the classes that may have links at all: a hash-chosen share of the shingles, larger than the prefixes,
comes first in the order and is counted over all documents. A class is active if its prefix, rare shingles first, has
one that occurs elsewhere. Then all shingles of the active classes are counted among them. A class of n shingles with
less than t n that occur in other classes is done; of the others, only these shared shingles are kept, rare first, and
the first of them up to the prefix are posted.

Of the postings of a shingle, three filters leave the pairs to verify: the sizes; the bound that the positions give on
the common shingles before, at and after them, where shingles of one class alone never count; and a bound by the sizes
of eight parts of the two sets by hash, on what follows. Groups of near copies would have pairs in the square of their
size. So candidates are first paired with one class per shingle only, the one with the smallest share of shingles of
its own, which is near the middle of such a group; links are joined to components, and only pairs that still lie in
different components follow, each verified once. What lies in one component needs no further link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Words, column, forget, mix, parquet, parts_for, settle, slices, sql_window, sql_words, windows, written
from corpusloom.llm.exchange import blobs, bucket_edges, buckets_for, i64, key_filter, u64

WIDTH, PERCENT = 5, 80
#: The counted share of shingles, as the highest hash; more than the 1/5 that prefixes take.
COUNTED = np.uint64(int(0.3 * 2**64))
STAR_ROUNDS = 2
#: Text of which a shingle is sent once.
EXCHANGED_BYTES = 8 << 20
#: Tasks that the nodes of one component are dealt over.
SALTS = 16


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text, words in lower case (A-Z)."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    grams = windows(hashes, width, 3)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = hi - lo
        # A short text is one shingle, told apart by its length.
        own = grams[lo : hi - width + 1] if n >= width else windows(hashes[lo:hi], n, 100 + n) if n else hashes[:0]
        out.append(np.unique(own))
    return out


def prefix_length(n, percent: int = PERCENT):
    return n - (-(-n * percent // 100)) + 1


SLICES = "b long, docs binary, none binary, ids binary, n binary, h1 binary, h2 binary, n_counted binary, n_keys binary, keys binary"
_SALT = np.uint64(0x5851F42D4C957F2D)


class _Chunks:
    """Packs the cells of slices into rows of about EXCHANGED_BYTES of text, numbered within the task."""

    def __init__(self, schema: str):
        self.names = [x.split()[0] for x in schema.split(", ")]
        self.part, self.number, self.held, self.size = TaskContext.get().partitionId(), 0, [], 0

    def add(self, cells: list[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
        self.held.append(cells)
        self.size += size
        if self.size >= EXCHANGED_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            cells = [np.concatenate(x).tobytes() for x in zip(*self.held, strict=True)]
            b = (self.part << 32) + self.number
            self.number, self.held, self.size = self.number + 1, [], 0
            yield pa.record_batch([pa.array([b], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], self.names)


def _shingled(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(SLICES)
        for batch in batches:
            texts = column(batch, "t").fill_null("")
            for lo, hi in slices(texts):
                sets = shingle_sets(texts[lo:hi], width)
                n = np.array([len(s) for s in sets], np.int64)
                counted = np.array([int(np.searchsorted(s, COUNTED)) for s in sets], np.int64)
                # Sorted by hash, the counted ones come first; of the others, as many as the prefix may reach.
                n_keys = np.where(n > 0, np.maximum(counted, prefix_length(n, percent)), 0)
                with np.errstate(over="ignore"):
                    h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                    h2 = np.array([(mix(s ^ _SALT) * (mix(s) | np.uint64(1))).sum(dtype=np.uint64) for s in sets], np.uint64)
                keys = np.concatenate([s[:k] for s, k in zip(sets, n_keys.tolist(), strict=True)])
                docs = column(batch, "k")[lo:hi]
                none, docs = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
                ids = column(batch, "id")[lo:hi].to_numpy()
                yield from chunks.add([docs, none, ids, n, h1, h2, counted, n_keys, keys], int(texts[lo:hi].nbytes))
        yield from chunks.rest()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of the slices."""
    for batch in batches:
        for row in range(len(batch)):
            docs, ids, n, h1, h2 = (i64(column(batch, c)[row]) for c in ("docs", "ids", "n", "h1", "h2"))
            b = np.full(len(docs), column(batch, "b")[row].as_py())
            keys = pa.array(docs, mask=np.frombuffer(column(batch, "none")[row].as_buffer(), bool))
            yield pa.record_batch([pa.array(b), pa.array(np.arange(len(docs))), keys, *(pa.array(x) for x in (ids, n, h1, h2))], ["b", "nth", "k", "id", "n", "h1", "h2"])


def _keys(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a slice and the member of the slice that has each."""
    n_keys = i64(column(batch, "n_keys")[row])
    return u64(column(batch, "keys")[row]), np.repeat(np.arange(len(n_keys)), n_keys)


def _frequencies(table: DataFrame, buckets: int, below: np.uint64 | None = None) -> DataFrame:
    """(b, found): for each slice, its keys (those below a bound) that more than one member of any slice has, with
    their numbers of members."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, count = np.unique(u64(column(batch, "keys")[row]), return_counts=True)
                if below is not None:
                    keys = keys[: np.searchsorted(keys, below)]
                edges = bucket_edges(keys, buckets)
                full = np.flatnonzero(np.diff(edges))
                b = column(batch, "b")[row].as_py()
                yield pa.record_batch([pa.array(full, pa.int64()), pa.array([b] * len(full), pa.int64()), blobs(keys[edges[i] : edges[i + 1]] for i in full), blobs(count[edges[i] : edges[i + 1]].astype(np.int32) for i in full)], ["bucket", "b", "keys", "count"])

    def answer(table: pa.Table) -> pa.Table:
        parts = [u64(k) for k in table.column("keys")]
        count = np.concatenate([np.frombuffer(c.as_buffer(), np.int32) for c in table.column("count")])
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(which, weights=count).astype(np.int64)[which]
        splits = np.cumsum([len(p) for p in parts])[:-1]
        found = [(p[t > 1], t[t > 1].astype(np.int32)) for p, t in zip(parts, np.split(total, splits), strict=True)]
        keep = [i for i, (f, _) in enumerate(found) if len(f)]
        return pa.table({"b": table.column("b").take(pa.array(keep, pa.int64())), "keys": blobs(found[i][0] for i in keep), "df": blobs(found[i][1] for i in keep)})

    sent = table.select("b", "keys").mapInArrow(send, "bucket long, b long, keys binary, count binary")
    return sent.groupBy("bucket").applyInArrow(answer, "b long, keys binary, df binary").groupBy("b").agg(F.collect_list(F.struct("keys", "df")).alias("found"))


def _looked_up(answers, keys: np.ndarray) -> np.ndarray:
    """The number of members for each key; 1 for those without an answer."""
    df = np.ones(len(keys), np.int64)
    if answers is not None and len(answers) and len(keys):
        known = np.concatenate([u64(x) for x in answers.field("keys")])
        total = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in answers.field("df")])
        order = np.argsort(known)
        known, total = known[order], total[order]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        df[hit] = total[at[hit]]
    return df


def _active(percent: int):
    """(c, k, id) of the classes with a prefix that has a repeated or an uncounted shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, doc = _keys(batch, row)
                own = column(batch, "own")[row].values
                n, n_counted, docs, ids = (i64(column(batch, c)[row]) for c in ("n", "n_counted", "docs", "ids"))
                cls = np.full(len(n), -1, np.int64)
                cls[own.field("nth").to_numpy()] = own.field("c").to_numpy()
                single = (_looked_up(column(batch, "found")[row].values, keys) == 1) & (keys < COUNTED)
                # Singles come first: is there anything but them in the prefix?
                hit = (np.bincount(doc[single], minlength=len(n)) < prefix_length(n, percent)) & (cls >= 0)
                none = np.frombuffer(column(batch, "none")[row].as_buffer(), bool)
                yield pa.record_batch([pa.array(cls[hit]), pa.array(docs[hit], mask=none[hit]), pa.array(ids[hit])], ["c", "k", "id"])

    return run


SETS = "b long, c binary, n_keys binary, keys binary"


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(SETS)
        for batch in batches:
            texts = column(batch, "t")
            for lo, hi in slices(texts):
                sets = shingle_sets(texts[lo:hi], width)
                yield from chunks.add([column(batch, "c")[lo:hi].to_numpy(), np.array([len(s) for s in sets], np.int64), np.concatenate(sets)], int(texts[lo:hi].nbytes))
        yield from chunks.rest()

    return run


SHARED = "c long, n long, own long, s1 long, s2 long, shared binary"


def _shared(percent: int):
    """For each class that may have links, its shingles that other classes have, in the order of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, member = _keys(batch, row)
                c, n = i64(column(batch, "c")[row]), i64(column(batch, "n_keys")[row])
                df = _looked_up(column(batch, "found")[row].values, keys)
                kept = np.bincount(member[df > 1], minlength=len(n))
                hit = kept * 100 >= n * percent
                mine = np.flatnonzero((df > 1) & hit[member])
                mine = mine[np.lexsort((keys[mine], df[mine], member[mine]))]
                part = (mix(keys[mine] ^ _SALT) >> np.uint64(61)).astype(np.int64)
                sizes = np.minimum(np.bincount(member[mine] * 8 + part, minlength=len(n) * 8).reshape(-1, 8), 0x7FFF).astype(np.uint64)
                s1, s2 = ((sizes[:, k : k + 4] << np.array([0, 16, 32, 48], np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64) for k in (0, 4))
                sets = np.split(keys[mine], np.cumsum(np.where(hit, kept, 0))[:-1])
                yield pa.record_batch([*(pa.array(x[hit]) for x in (c, n, n - kept, s1, s2)), blobs(x for x, h in zip(sets, hit, strict=True) if h)], [x.split()[0] for x in SHARED.split(", ")])

    return run


POSTINGS = "key long, c long, n long, own long, at long, s1 long, s2 long"


def _posted(percent: int):
    """Postings of the shared shingles in the prefix; `at` is the place among them, after the `own` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = column(batch, "n").to_numpy(), column(batch, "own").to_numpy()
            count = np.maximum(prefix_length(n, percent) - own, 0)
            keys = [u64(x)[:k] for x, k in zip(column(batch, "shared"), count.tolist(), strict=True)]
            row = np.repeat(np.arange(len(n)), [len(k) for k in keys])
            at = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
            columns = [column(batch, c).to_numpy()[row] for c in ("c", "n", "own", "s1", "s2")]
            yield pa.record_batch([pa.array(x) for x in ((np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64), *columns[:3], at, *columns[3:])], [x.split()[0] for x in POSTINGS.split(", ")])

    return run


def _possible(percent: int):
    """The filters on a pair of postings x and y of one key, as a condition."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    both = x("n") + y("n")
    need = F.ceil(both * percent / (100 + percent) - 1e-9)  # common shingles of two sets with that similarity, at least
    length = F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent
    after = lambda r: r("n") - r("own") - r("at") - 1
    most = F.least(x("at"), y("at")) + 1 + F.least(after(x), after(y))
    part = lambda r, s, k: F.shiftright(r(s), 16 * k).bitwiseAND(F.lit(0xFFFF))
    apart = sum((F.abs(part(x, s, k) - part(y, s, k)) for s in ("s1", "s2") for k in range(4)), x("own") + y("own"))
    return length & (most >= need) & (apart <= both - 2 * need)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(column(batch, "sx"), column(batch, "sy"), column(batch, "n").to_pylist(), strict=True):
                both = np.sort(np.concatenate([u64(x), u64(y)]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (n - common))
            yield pa.record_batch([column(batch, "x"), column(batch, "y")], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, label): for nodes(c, label) and links(x, y), the smallest label of those that links join.

    Each round a node takes the smallest label of its neighbours, then that of the node its label names, so long paths
    halve. Every round is a table in the shared folder; none is on the driver.
    """
    edges = written(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(edges.select(F.col("x").alias("c")).distinct().withColumn("label", F.col("c")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("c", "y"), "y").groupBy(F.col("x").alias("c")).agg(F.min("label").alias("near"))
        new = labels.join(around, "c").select("c", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        # Only labels that are in use and have a smaller one are joined; the nodes of a large component are dealt by salt.
        jump = new.select(F.col("c").alias("new"), F.col("new").alias("next")).where("next < new").join(new.select("new").distinct(), "new")
        jump = jump.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        new = new.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).join(jump, ["new", "salt"], "left")
        new = written(new.select("c", F.coalesce("next", "new").alias("label"), "old"), "labels")
        forget(labels)
        labels = new.select("c", "label")
        labels._corpusloom_path = new._corpusloom_path
        if not new.where("label != old").limit(1).count():
            break
    return nodes.select("c").join(labels, "c", "left").select("c", F.coalesce("label", "c").alias("label"))


def _cross(postings: DataFrame, labels: DataFrame, done: DataFrame | None, star: bool, percent: int) -> DataFrame:
    """Pairs of postings of one key in different components, that pass the filters and aren't verified yet."""
    own = postings.join(labels, "c")
    record = F.struct("c", "n", "own", "at", "s1", "s2", "label")
    middle = F.min_by(record, F.struct((F.col("own") / F.col("n")).alias("r"), "c"))
    spread = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), middle.alias("head")).where("low != high")
    if star:
        pairs = own.select("key", record.alias("y")).join(spread.select("key", F.col("head").alias("x")), "key")
    else:
        # Sets with that similarity have sizes in one class of ratio 100 / percent or in neighbouring ones.
        size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
        own = own.join(spread.select("key"), "key", "left_semi").select("key", size.cast("long").alias("size"), record.alias("r"))
        near = own.select("key", F.explode(F.array("size", F.col("size") + 1)).alias("size"), F.col("r").alias("x"))
        first = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.c") < F.col("y.c")))
        pairs = near.join(own.select("key", "size", F.col("r").alias("y")), ["key", "size"]).where(first)
    pairs = pairs.where((F.col("x.label") != F.col("y.label")) & _possible(percent))
    pairs = pairs.select(F.least("x.c", "y.c").alias("x"), F.greatest("x.c", "y.c").alias("y")).distinct()
    return pairs.join(done, ["x", "y"], "left_anti") if done is not None else pairs


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(b, nth, k, id, n_shingles, class_id, component, component_id) for every row of df.

    k is the key, id the hash of the text, (b, nth) the place of the row in the slices, class_id is the
    smallest key of the rows with that set, component a number of one run, and component_id the smallest key of the component.

    A text without words, or a null one, has no shingles, is linked with nothing and is a component of its own row's
    key. Texts with equal sets are one class, with similarity 1. Component ids are the smallest keys; null keys are
    passed over in that, and a component of null keys only has a null id. Repeated rows are reported each. Links of
    all pairs at `percent` or more are respected; the result has components, not pairs. An empty table gives no rows. Other
    columns are not looked at. Keys have to be integers, else ValueError is raised.
    """
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} is not an integer")
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("id", F.xxhash64("t"))
    table = written(rows.mapInArrow(_shingled(percent, width), SLICES), "shingles")
    docs = table.select("b", "docs", "none", "ids", "n", "h1", "h2").mapInArrow(_documents, "b long, nth long, k long, id long, n long, h1 long, h2 long")
    full = docs.where("n > 0")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("k").alias("low"), F.min(F.struct("b", "nth", "k", "id")).alias("one"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    keys = table.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    # Counted keys fill 3/10 of the range of hashes.
    found = _frequencies(table, buckets_for(keys * 10 // 3, parts_for(spark)), COUNTED)
    own = classes.groupBy("one.b").agg(F.collect_list(F.struct("one.nth", "c")).alias("own"))
    known = table.select("b", "docs", "none", "ids", "n", "n_counted", "n_keys", "keys").join(own, "b").join(found, "b", "left")
    active = known.mapInArrow(_active(percent), "c long, k long, id long")
    active = written(active.withColumn("h", F.xxhash64("k", "id")), "active")
    settle(spark)
    passes = key_filter(active, "h")
    texts = rows.withColumn("h", F.xxhash64("k", "id")).where(passes(F.col("h"))).join(active.select("c", F.col("k").alias("ak"), F.col("id").alias("aid"), "h"), "h").where(F.col("k").eqNullSafe(F.col("ak")) & (F.col("id") == F.col("aid")))
    sets = written(texts.groupBy("h", "c").agg(F.first("t").alias("t")).select("c", "t").mapInArrow(_set_rows(width), SETS), "sets")
    settle(spark)
    keys = sets.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // 8
    shared = sets.join(_frequencies(sets, buckets_for(keys, parts_for(spark))), "b", "left").mapInArrow(_shared(percent), SHARED)
    shared = written(shared, "shared")
    forget(sets)
    settle(spark)
    postings = written(shared.mapInArrow(_posted(percent), POSTINGS), "postings")

    nodes = shared.select("c")
    labels = nodes.select("c", F.col("c").alias("label"))
    links, done = None, None
    for star in [True] * STAR_ROUNDS + [False]:
        pairs = written(_cross(postings, labels, done, star, percent), "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        left = shared.select(F.col("c").alias("x"), F.col("shared").alias("sx"), F.col("n").alias("nx"))
        right = shared.select(F.col("c").alias("y"), F.col("shared").alias("sy"), F.col("n").alias("ny"))
        sized = pairs.join(left, "x").join(right, "y").select("x", "y", "sx", "sy", (F.col("nx") + F.col("ny")).alias("n"))
        new = written(sized.mapInArrow(_verified(percent), "x long, y long"), "links")
        settle(spark)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = written(components(links, nodes), "components")
    if links is None:
        labels = written(labels, "components")
    forget(shared)
    forget(postings)
    lows = classes.select("h1", "h2", "n", "c", "low").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    smallest = lows.groupBy("label").agg(F.min("low").alias("component_id"))
    lows = lows.join(smallest, "label").select("h1", "h2", "n", F.col("low").alias("class_id"), F.col("label").alias("component"), "component_id")
    out = full.join(lows, ["h1", "h2", "n"]).select("b", "nth", "k", "id", F.col("n").alias("n_shingles"), "class_id", "component", "component_id")
    alone = docs.where("n = 0").select("b", "nth", "k", "id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component"), F.col("k").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without the later documents of each component; the one with the smallest key stays.

    Texts without words stay all. Of repeated rows with that key one stays, if the texts are equal or near copies.
    """
    found = written(jaccard_components(df, key, text), "found")
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "id")).alias("head")
    head = found.where("n_shingles > 0").groupBy("component").agg(first).select("head.k", "head.id")
    empty = found.where("n_shingles = 0").select("k", "id").dropDuplicates()
    stay = head.withColumn("single", F.lit(True)).unionByName(empty.withColumn("single", F.lit(False)))
    # Rows that repeat the key and text of one that stays: of those one stays.
    again = found.groupBy("k", "id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    stay = stay.join(again.select(F.col("k").alias("rk"), F.col("id").alias("rid"), F.lit(True).alias("again")), F.col("k").eqNullSafe(F.col("rk")) & (F.col("id") == F.col("rid")), "left")
    stay = written(stay.select(F.col("k").alias("_loom_k"), F.col("id").alias("_loom_id"), (F.col("single") & F.coalesce("again", F.lit(False))).alias("again")), "stay")
    kept = df.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("_loom_key"), F.xxhash64(text).alias("_loom_text"))
    kept = kept.join(stay, F.col("_loom_key").eqNullSafe(F.col("_loom_k")) & (F.col("_loom_text") == F.col("_loom_id")))
    single = kept.where("again").groupBy("_loom_k", "_loom_id").agg(F.first("row").alias("row")).select("row.*")
    return kept.where("NOT again").select("row.*").unionByName(single)


def op3_ngram_jaccard(spark, sf_dir):
    found = jaccard_components(parquet(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), "n_shingles", "component_id", "class_id")


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
SQL = {
    "op3_ngram_jaccard": f"""
    WITH RECURSIVE words AS ({sql_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
    ), shingles AS (
      SELECT DISTINCT doc_id, content FROM (
        SELECT doc_id, {sql_window(WIDTH)} AS content FROM words WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
        UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY i) FROM words WHERE n_words < {WIDTH} GROUP BY doc_id
      ) WHERE content IS NOT NULL
    ), sets AS (
      SELECT doc_id, count(*) AS n, sha256(string_agg(content, chr(10) ORDER BY content)) AS of FROM shingles GROUP BY doc_id
    ), classes AS (
      SELECT doc_id, n, min(doc_id) OVER (PARTITION BY of) AS class_id FROM sets
    ), entries AS (
      SELECT class_id, n, content FROM classes JOIN shingles USING (doc_id) WHERE doc_id = class_id
    ), links AS (
      SELECT x.class_id AS x, y.class_id AS y FROM entries x JOIN entries y USING (content)
      WHERE x.class_id <> y.class_id AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)
      GROUP BY x.class_id, y.class_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))
    ), reached AS (
      SELECT DISTINCT class_id AS x, class_id AS y FROM classes
      UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x
    ), components AS (SELECT x AS class_id, min(y) AS component_id FROM reached GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, class_id
    FROM documents LEFT JOIN classes USING (doc_id) LEFT JOIN components USING (class_id)"""
}
