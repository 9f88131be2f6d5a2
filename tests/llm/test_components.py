import random

import pytest

from sigtrace.llm import components as C
from sigtrace.operators import skew
from sigtrace.sources.shared import RunFolder


def brute(pairs, known=None):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b or known is not None and (a not in known or b not in known):
            continue
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {(find(x), x) for x in up}


def groups(spark, pairs, known=None):
    df = spark.createDataFrame(pairs, "l string, r string, group_id int" if len(pairs) and len(pairs[0]) == 3 else "l string, r string")
    k = None if known is None else spark.createDataFrame([(x,) for x in known], "id string")
    rows = [(r.group_id, r.id) for r in C.connected_groups(df, "l", "r", k).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_chain_star_and_loops(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    star = [("s", f"t{i}") for i in range(200)]
    odd = [("x", "x"), (None, "y"), ("y", None), ("a", "b"), ("b", "a"), ("a", "b")]
    pairs = chain + star + odd
    random.Random(1).shuffle(pairs)
    assert groups(spark, pairs) == brute(pairs)


def test_hot_vertices_take_the_other_join(spark, monkeypatch):
    """With a low bound the large groups go by broadcast, the small ones by shuffle."""
    monkeypatch.setattr(skew, "HOT", 5)
    rnd = random.Random(2)
    pairs = [(f"v{rnd.randint(0, 300)}", f"v{rnd.randint(0, 300)}") for _ in range(330)] + [("h", f"w{i}") for i in range(60)]
    assert groups(spark, pairs) == brute(pairs)


def test_unknown_ids_and_empty(spark):
    pairs = [("a", "b"), ("b", "zz"), ("zz", "c"), ("c", "d")]
    known = ["a", "b", "c", "d", "e", "a"]
    assert groups(spark, pairs, known) == brute(pairs, set(known)) == {("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")}
    assert groups(spark, []) == set()
    assert C.hash_to_min(spark.createDataFrame([], "a long, b long"), RunFolder(spark, "t")).count() == 0


def test_single_vertices_have_a_row_too(spark):
    links = spark.createDataFrame([("b", "a"), ("a", "gone"), ("c", "c")], "l string, r string")
    known = spark.createDataFrame([(x,) for x in ("a", "b", "c", " d ", None, "", "c")], "id string")
    got = sorted((r.group_id, r.id) for r in C.connected_groups(links, "l", "r", known, C.text_key, singles=True).collect())
    assert got == [("a", "a"), ("a", "b"), ("c", "c"), ("d", "d")]


def test_few_keys_are_hot_however_many_rows(spark):
    assert skew.hot_size(10) == skew.HOT and skew.hot_size(10**12) * skew.MOST_HOT >= 10**12 and 10**12 // skew.hot_size(10**12) <= skew.MOST_HOT


@pytest.mark.parametrize("text", ["0B2F6A1E-8d1c-5c51-9a52-7a8f0c6d5e11", " {0b2f6a1e-8d1c-5c51-9a52-7a8f0c6d5e11} ", "urn:uuid:0b2f6a1e-8d1c-5c51-9a52-7a8f0c6d5e11", "0b2f6a1e8d1c5c519a527a8f0c6d5e11"])
def test_uuids_however_written(spark, text):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,), ("no uuid",), (None,)], "u string")
    assert [r.k for r in df.select(C.uuid_key(F.col("u")).alias("k")).collect()] == ["0b2f6a1e8d1c5c519a527a8f0c6d5e11", None, None]
