import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import recompress
from corpusloom.llm.common import mix
from tests.llm import brute


def test_report(docs, rows, empty):
    want = {d: (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, (w, kept) in brute.without_repeats([(r[0], r[1]) for r in rows]).items()}
    got = {r.doc_id: tuple(r)[1:] for r in recompress.removal_report(docs).collect()}
    assert got == want
    assert any(x[1] for x in want.values())
    assert recompress.removal_report(empty).count() == 0


def test_texts(odd, rows):
    want = brute.without_repeats([(r[0], r[1]) for r in rows])
    out = recompress.without_repeats(odd)
    assert out.columns == odd.columns
    seen = out.collect()
    assert len(seen) == odd.count()
    for r in seen:
        if r.doc_id is None:
            continue
        w, kept = want[r.doc_id]
        assert r.text == " ".join(kept) if len(kept) < len(w) else True
        assert brute.words(r.text) == kept


def window_symbol(left, window, right):
    names = mix(np.array(left + window + right, np.uint64))
    own, _ = recompress.symbols(names, np.array([0]), len(window))
    return int(own[len(left)])


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13, 14, 40])
def test_equal_windows_have_equal_symbols(width):
    r = random.Random(width)
    for alphabet in (1, 2, 3, 50, 10_000):
        for _ in range(40):
            window = [r.randrange(alphabet) for _ in range(width)]
            if r.random() < 0.3:  # runs
                window = sorted(window)
            seen = set()
            for _ in range(6):
                left, right = ([r.randrange(alphabet) for _ in range(r.randint(0, 20))] for _ in range(2))
                seen.add(window_symbol(left + window[:1] * r.randint(0, 3), window, window[-1:] * r.randint(0, 3) + right))
            assert len(seen) == 1 and int(recompress.NONE) not in seen


def test_symbols_tell_windows_apart():
    r = random.Random(9)
    seen = [window_symbol([], [r.randrange(50) for _ in range(13)], []) for _ in range(300)]
    assert len(set(seen)) > 290


def test_texts_do_not_mix():
    names = mix(np.arange(40, dtype=np.uint64))
    out, _ = recompress.symbols(names, np.array([0, 12, 12, 25]))
    none = out == recompress.NONE
    assert none[:12].all() and not none[12] and none[13:25].all() and not none[25:28].any() and none[28:].all()


def test_last_symbols_are_those_of_texts():
    r = random.Random(4)
    texts = [[r.randrange(k) for _ in range(n)] for n in (0, 1, 2, 13, 400) for k in (1, 2, 30) for _ in range(4)]
    texts += texts[::-1]
    names, first = mix(np.array([w for t in texts for w in t], np.uint64)), np.cumsum([0] + [len(t) for t in texts[:-1]])
    _, tops = recompress.symbols(names, first)
    by = {}
    for t, top in zip(texts, tops.tolist(), strict=True):
        assert by.setdefault(tuple(t), top) == top
    assert len(set(by.values())) == len(by)


def test_rounds_name_runs_and_pairs():
    names = mix(np.array([1, 1, 1, 2, 3, 1, 1, 1, 2, 3], np.uint64))
    step = recompress.Round(names, np.arange(10), np.arange(10) == 0, 0)
    assert step.run.tolist() == [0, 0, 0, 1, 2, 3, 3, 3, 4, 5]
    assert len(step.names) < 7 and step.names[-1] == step.names[len(step.names) // 2 - 1]


@pytest.mark.parametrize("width", [1, 4, 9, 30])
def test_report_at_other_widths(docs, rows, width):
    want = {d: len(w) - len(kept) for d, (w, kept) in brute.without_repeats([(r[0], r[1]) for r in rows], width).items()}
    assert {r.doc_id: r.n_removed for r in recompress.removal_report(docs, width=width).collect()} == want


def test_wrong_arguments(docs):
    with pytest.raises(ValueError):
        recompress.removal_report(docs, width=0)
    with pytest.raises(ValueError):
        recompress.removal_report(docs, key="text")


def test_least_key_is_a_key(spark):
    """The smallest long is a key like others, apart from null."""
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(-(1 << 63), text), (1, text), (None, text), (2, "x " + text)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in recompress.removal_report(df).collect()} == {(-(1 << 63), 0), (1, 20), (None, 0), (2, 20)}


def test_chunks_change_nothing(docs, monkeypatch):
    want = sorted(map(tuple, recompress.removal_report(docs).collect()), key=str)
    monkeypatch.setattr(recompress, "CHUNK_BYTES", 500)
    assert sorted(map(tuple, recompress.removal_report(docs).collect()), key=str) == want
