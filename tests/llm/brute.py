"""Plain versions of the operators."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    """docs: (id, text), ids distinct -> id: (set size, component)."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = top(x), top(y)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def without_repeats(docs, width=13):
    """docs: (id, text) -> id: (words, kept words)."""
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w, gone = words(t), set()
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), d) < d:
                gone.update(range(i, i + width))
        out[d] = (w, [x for i, x in enumerate(w) if i not in gone])
    return out


def counts(text):
    t, w = text or "", words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
