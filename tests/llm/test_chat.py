import itertools
import random
import re

import pytest

from corpusloom.llm import chat


def cheapest(roles):
    """Least cost over all legal sequences, by exhaustive search."""
    best = [chat.FAR]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + chat.CLOSING[state])
            return
        for c, to, _ in chat._options(state, roles[i]):
            go(i + 1, to, cost + c)

    go(0, chat.NONE, 0)
    return best[0]


def plain_cheapest(roles):
    """Least cost over all ways to treat each row, told legal by a pattern; shares nothing with the operator. S, U and A
    are roles, a merge costs 1 into its own role and 3 into another, another role 2, an empty turn 2."""
    ways, best = [("merge", "", "")] + [("turn", x, y) for x in ("", "S", "U", "A") for y in "SUA"], 1 << 30
    for choice in itertools.product(ways, repeat=len(roles)):
        turns, cost = "", 0
        for role, (kind, before, own) in zip(roles, choice, strict=True):
            if kind == "merge":
                if not turns:
                    break
                cost += 1 if turns[-1] == role else 3
            else:
                turns += before + own
                cost += 2 * len(before) + 2 * (own != role)
        else:
            best = min([best, *(cost + 2 * len(end) for end in ("", "A", "UA") if re.fullmatch("S?(UA)+", turns + end))])
    return best


def test_search_is_that_of_a_plain_one():
    """The dynamic program, and the search that tests it, against all ways for short conversations."""
    letters = {"S": chat.SYSTEM, "U": chat.USER, "A": chat.ASSISTANT, "-": chat.NONE}
    for n in (1, 2, 3):
        for roles in itertools.product("SUA-", repeat=n):
            codes = [letters[x] for x in roles]
            cost, _ = chat.solve(codes, chat.NONE)
            assert plain_cheapest(roles) == cheapest(codes) == min(c + chat.CLOSING[e] for e, c in enumerate(cost))


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "user", "there")], "conv_id long, turn long, role string, text string")
    more = df.withColumns({c: F.lit(c) for c in ("part", "nth", "d", "x", "kind", "pair", "conv", "costs", "final", "fragment", "id")})
    assert sorted(map(tuple, chat.repair_roles(more).collect()), key=str) == sorted(map(tuple, chat.repair_roles(df).collect()), key=str)


def cost_of(rows):
    """Cost of a result, testing that it is legal."""
    cost, state = 0, chat.NONE
    for r in rows:
        role = chat.ROLES.index(r.role) if r.role in chat.ROLES else chat.NONE
        new = chat.ROLES.index(r.new_role)
        if r.kind == "merged":
            assert new == state != chat.NONE
            cost += chat.MERGE_SAME if new == role else chat.MERGE_OTHER
            continue
        if r.inserted:
            x = chat.ROLES.index(r.inserted)
            assert x in chat.NEXT[state]
            state, cost = x, cost + chat.INSERT
        assert new in chat.NEXT[state]
        state, cost = new, cost + chat.RELABEL * (new != role)
    assert all(not r.closing for r in rows[:-1])
    for c in rows[-1].closing:
        assert chat.ROLES.index(c) in chat.NEXT[state]
        state, cost = chat.ROLES.index(c), cost + chat.INSERT
    assert state == chat.ASSISTANT
    return cost


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_repair(spark, partitions):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None, "user"]), r.choice(["x", "", None, "longer text"])) for c in range(30) for t in range(r.randint(1, 7))]
    rows += [(99, t, r.choice(["user", "assistant"]), "same") for t in range(200)] + [(98, 0, "user", "same")] * 40 + [(None, 1, "user", "null"), (None, 2, "user", None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = chat.rendered(chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(out) == len(rows)
    by = {}
    for x in sorted(out, key=lambda x: (x.part, x.nth)):
        by.setdefault(x.conv_id, []).append(x)
    for conv, turns in by.items():
        assert [x.turn for x in turns] == sorted(x[1] for x in rows if x[0] == conv)
        if len(turns) < 10:
            assert cost_of(turns) == cheapest([chat.ROLES.index(x.role) if x.role in chat.ROLES else 0 for x in turns])
        else:
            cost_of(turns)


def test_rendering(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "yes"), (1, 3, "user", None)]
    out = chat.rendered(chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).orderBy("part", "nth").collect()
    text = "".join(r.fragment for r in out)
    assert text == "<|user|>\nhi\nthere\n<|assistant|>\nyes\n<|user|>\n\n<|assistant|>\n"


def test_empty(spark):
    assert chat.repair_roles(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
