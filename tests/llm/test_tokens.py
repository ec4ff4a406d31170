import hashlib
import random
import re
from array import array

import numpy as np
import pytest

from corpusloom.llm import bpe, packing, unigram

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_is_exact(library, rows):
    own, other = bpe.tokenizer(bpe.default_path()), bpe.id_maker(bpe.default_path())
    r = random.Random(2)
    alphabet = "aaabbbthe ing's't’Éß漢字́İΣςſ1²٣!?.-_\n\t\x1c\x85😀ǅŉ"
    texts = [t or "" for _, t, *_ in rows] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * n for n in (1, 2, 63, 5000)] + ["ab" * 2000, "<|startoftext|>x<|endoftext|><|", "a" + chr(0x558) + "b"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = array("H", own.encode(t))
        assert list(got) == want and other.encode(t) == got.tobytes()
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_query(odd, empty, library):
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_texts(odd).collect()), key=str)
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert bpe.encode_texts(empty).count() == 0


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 3)
    small, large = bpe.WordBpe(bpe.default_path()), bpe.tokenizer(bpe.default_path())
    for t in ("some words and some more words of many kinds", "kinds of words"):
        assert small.encode(t) == large.encode(t)


@pytest.mark.parametrize("frame", ["odd", "docs"])
def test_packing(request, library, frame):
    df = request.getfixturevalue(frame)
    out = packing.pack(df, length=64, quantum=8).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    want = sorted(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in df.collect())
    assert sum(len(x) for x in want) == sum(len(r.ids) for r in out)
    if frame == "docs":
        got = sorted(b"".join(bytes(r.ids) for r in sorted(parts, key=lambda r: r.start)) for parts in by_doc.values())
        assert got == want


def shares(out, home, length):
    """Tokens of each source in each window, after a test that windows are full and without gaps."""
    windows, fill = {}, {}
    for r in out:
        own = windows.setdefault(r.sequence_id, {})
        own[home[r.doc_id]] = own.get(home[r.doc_id], 0) + r.length
        fill.setdefault(r.sequence_id, []).extend(range(r.offset, r.offset + r.length))
    assert sorted(windows) == list(range(len(windows)))
    for s, x in fill.items():
        assert sorted(x) == list(range(len(x))) and (len(x) == length or s == max(fill))
    return windows


def test_shares_of_the_corpus(spark, monkeypatch):
    """Each window has each source's share, hot sources and many small ones alike, over cells and partitions."""
    monkeypatch.setattr(packing, "CELL", 4096)
    monkeypatch.setattr(packing, "CELL_GROUP", 2)
    hot = [(i, "some words here " * 20, f"hot{i % 3}") for i in range(240)]
    small = [(1000 + i, "some words", f"small{i % 600}") for i in range(600)]
    df = spark.createDataFrame(hot + small, "doc_id long, text string, source string").repartition(5)
    out = packing.pack(df, length=512, quantum=8).collect()
    windows = shares(out, {r[0]: r[2] for r in hot + small}, 512)
    total = {s: sum(w.get(s, 0) for w in windows.values()) for s in {r[2] for r in hot + small}}
    tokens = sum(total.values())
    assert len(windows) > 20 and len(total) == 603
    assert tokens == sum(r.doc_tokens for r in {r.doc_id: r for r in out}.values())
    for w in sorted(windows)[:-1]:
        for s in ("hot0", "hot1", "hot2"):
            assert abs(windows[w].get(s, 0) - 512 * total[s] / tokens) <= 4 * 8
        assert any(s.startswith("small") for s in windows[w])


def test_shares_by_targets(spark):
    """Windows have the target shares while all queues last; those with none share what is left."""
    rows = [(i, "some words here " * 20, "abcd"[i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    home = {r[0]: r[2] for r in rows}
    windows = shares(packing.pack(df, length=512, quantum=16, targets={"a": 0.5, "b": 0.3}).collect(), home, 512)
    want = {"a": 256, "b": 153.6, "c": 51.2, "d": 51.2}
    lasting = 100 * 61 / 0.5 / 512  # windows until a is empty
    for w in range(int(lasting) - 1):
        assert all(abs(windows[w].get(s, 0) - x) <= 2 * 16 for s, x in want.items()), (w, windows[w])
    after = windows[int(lasting) + 2]
    assert "a" not in after and abs(after["b"] - 512 * 0.3 / 0.5) <= 32  # the others go on in their proportions
    windows = shares(packing.pack(df, length=512, quantum=16, targets={"a": 0.5, "b": 0.5}).collect(), home, 512)
    assert all(set(windows[w]) <= {"a", "b"} for w in range(20)) and set(windows[40]) == {"c", "d"}
    with pytest.raises(ValueError):
        packing.pack(df, targets={"a": 0.8, "b": 0.3})


def test_order_is_a_plain_round_robin_by_deficit(spark):
    """Positions are those of a plain sort by time, and at any place each source has had its share to within a turn."""
    sizes = {"s0": 5 * 8 - 1, "s1": 43, "s2": 2, "s3": 2, "s4": 23, "s5": 319}
    rows = [(i, "a " * (n - 1), s) for i, (s, n) in enumerate(sizes.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(df, length=64, quantum=8).collect()
    total, home = sum(sizes.values()), {r[0]: r[2] for r in rows}
    taken = {home[r.doc_id]: [] for r in out}
    for r in out:
        taken[home[r.doc_id]] += range(r.sequence_id * 64 + r.offset, r.sequence_id * 64 + r.offset + r.length)
    assert sorted(x for v in taken.values() for x in v) == list(range(total))
    for s, v in taken.items():
        assert len(v) == sizes[s]
        for at in range(total):
            # Another turn of each other source may be due before or after.
            assert abs(sum(x < at for x in v) - at * sizes[s] / total) <= 2 * 8 + 8 * len(sizes) * sizes[s] / total


def test_packing_many_sources_and_none(spark, empty):
    df = spark.createDataFrame([(i, "some words here", f"s{i}") for i in range(40)], "doc_id long, text string, source string")
    out = packing.pack(df, length=16, quantum=4).collect()
    assert sum(r.length for r in out) == 40 * 4 and len({r.doc_id for r in out}) == 40
    assert packing.pack(empty).count() == 0


def test_unigram_counts(odd, empty):
    vocab = unigram.vocabulary(bpe.default_path(unigram.NAME))
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(vocab, 0, False))
    model.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace("▁", "always")
    own = unigram.Counter(vocab)
    r = random.Random(3)
    texts = ["".join(r.choice("aabthe漢😀éß12!\x01ing") for _ in range(r.randint(1, 14))) for _ in range(2000)]
    for t in texts:
        assert own.count("▁" + t) == len(model.encode(t).ids)
    by_id = {r.doc_id: r.text for r in odd.collect()}
    for row in unigram.count_tokens(odd).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", by_id.get(row.doc_id) or "")
        if row.doc_id is not None:
            assert (row.n_words, row.n_tokens) == (len(words), sum(len(model.encode(w).ids) for w in words))
    assert unigram.count_tokens(empty).count() == 0


def test_unigram_ties_take_the_earlier_start():
    own = unigram.Counter([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0)])
    model = tokenizers.models.Unigram([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0)], 0, False)
    for t in ("abc", "aabc", "abcabc", "xxabcx", "bcab"):
        assert own.count(t) == len(model.tokenize(t))


def test_sha_of_query(spark, small):
    r = bpe.op7_bpe(spark, small).orderBy("doc_id").first()
    text = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").first().text
    ids = array("I", array("H", bpe.tokenizer(bpe.default_path()).encode(text)))
    assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
