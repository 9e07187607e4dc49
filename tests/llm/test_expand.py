"""Pairs of members against listing them one by one, with classes of many blocks; looks and mixtures by their classes."""

import random
from itertools import combinations

from lexmill.llm import expand, unify


def test_members_of_large_classes(spark):
    dice = random.Random(2)
    members = [(f"m{i:03}", 0 if i < 60 else dice.randrange(1, 9)) for i in range(150)]
    links = [(0, 1), (2, 0), (3, 4)]
    df = spark.createDataFrame(members, "id string, cls int")
    pairs = spark.createDataFrame(links, "a int, b int")
    joined = {frozenset(p) for p in links}
    want = {(x, y) for (x, a), (y, b) in combinations(sorted(members), 2) if a == b or frozenset((a, b)) in joined}
    got = [tuple(r) for r in expand.member_pairs(df, pairs, block=7).collect()]
    assert sorted(got) == sorted(want)
    across = [tuple(r) for r in expand.member_pairs(df, pairs, within=False, block=7).collect()]
    by = dict(members)
    assert sorted(across) == sorted(p for p in want if by[p[0]] != by[p[1]])
    assert expand.member_pairs(df.limit(0), pairs.limit(0)).collect() == []


def test_looks_by_class(spark):
    rows = [("a", "one word"), ("b", "one word"), ("c", "ｏne word"), ("d", "оne word"), ("e", "other"), ("f", None), ("g", " "), ("h", "other")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = {r.id: r for r in unify.look_groups(df).collect()}
    assert set(got) == set("abcd") and all(r.n_stored == 3 for r in got.values()) and got["a"].raw == got["b"].raw != got["c"].raw
    assert {tuple(r) for r in unify.same_look(df).collect()} == {("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
