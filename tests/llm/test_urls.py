import random

import duckdb
import pytest

from corpusloom.llm import urls

RULES = [*urls.RULES, ("block", "a.b.c", ""), ("allow", "b.c", "/x/y"), ("allow", "com", "/en/"), ("block", "c", "/x/"), ("allow", "c", "/x/y/z/longer")]


def plain(host, path, rules):
    fits = [(h.count("."), len(p), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[3:][::-1]) if fits else (None, "allow")


def random_urls(n):
    r = random.Random(4)
    hosts = ["example.com", "EXAMPLE.com", "a.b.c", "z.a.b.c", "b.c", "c", "com", "notcom", "example.net:80", "", ".com", "x..com", "org"]
    paths = ["", "/", "/en/", "/en/7", "/en/71/x", "/de/8", "/x/y", "/x/y/z/longer/still", "/x//y", "/es/a?b#c", "?q=/en/", "#/en/", "/EN/"]
    return [None, "", "no scheme", "http://", "://x.com/en/"] + [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(n)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(random_urls(300))], "page_id long, url string, host string, path string")


@pytest.mark.parametrize("most_bytes", [urls.MOST_BYTES, 0])
def test_against_plain(pages, most_bytes):
    got = urls.filter_urls(pages, RULES, most_bytes=most_bytes).collect()
    assert len(got) == pages.count()
    for r in got:
        assert (r.rule, r.verdict) == plain(r.host, r.path, RULES), (r.host, r.path)


def test_sql(spark, pages, small):
    for frame in (pages, spark.read.parquet(f"{small}/pages.parquet")):
        db = duckdb.connect()
        db.register("pages", frame.select("page_id", "url").toPandas())
        want = {x[0]: x[1:] for x in db.sql("SELECT page_id, host, path, rule, verdict FROM (" + urls.SQL["op8_url_filter"] + ")").fetchall()}
        got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(frame, urls.RULES).collect()}
        assert got == want


def test_repeated_rows(pages):
    got = sorted(map(tuple, urls.filter_urls(pages.unionByName(pages), RULES).collect()), key=str)
    assert got == sorted(2 * list(map(tuple, urls.filter_urls(pages, RULES).collect())), key=str)


def test_bound_counts_bytes(pages):
    """The trie is sent only if its entries are few in bytes, not in characters; both ways give the same."""
    rules = [("block", "com", "/é" * 3)]
    assert sorted(map(tuple, urls.filter_urls(pages, rules, most_bytes=9).collect()), key=str) == sorted(map(tuple, urls.filter_urls(pages, rules, most_bytes=99).collect()), key=str)


def test_empty(pages):
    assert urls.filter_urls(pages.limit(0), RULES).count() == 0


def test_many_entries_are_small():
    """What is broadcast is little more than the entries' own bytes, and finds what a plain search does."""
    import pickle

    r = random.Random(6)
    rules = [(r.choice(("block", "allow")), ".".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 4))), "/" + "/".join(r.choice("xyz") * r.randint(1, 4) for _ in range(r.randint(0, 5)))) for _ in range(60_000)]
    rules += [("block", "a", f"/{i:06d}/") for i in range(40_000)]
    trie, own = urls.Trie(rules), {(h, p): 0 for _, h, p in rules}
    raw = sum(len(h) + len(p) for h, p in own)
    assert trie.nbytes() < raw + 12 * len(own) + 100 and len(pickle.dumps(trie)) < 1.1 * trie.nbytes() + 1_000
    block = {(h, p) for v, h, p in rules if v == "block"}
    for _ in range(3_000):
        _, host, path = r.choice(rules)
        host, path = r.choice(["", "zz.", "a.", "x\x01y."]) + host, path[: r.randint(0, len(path))] + r.choice(["", "x", "/", "zz/y"])
        labels = host.split(".")
        want = None
        for k in range(1, len(labels) + 1):
            suffix = ".".join(labels[-k:])
            hit = next((path[:n] for n in range(len(path), -1, -1) if (suffix, path[:n]) in own), None)
            want = want if hit is None else (("block" if (suffix, hit) in block else "allow"), suffix + hit)
        assert trie.find(host, path) == want
    with pytest.raises(ValueError):
        urls.Trie([("block", "a\x00b", "/")])
