import random

import pytest
from pyspark.sql import functions as F

from sigtrace.functions import http
from sigtrace.operators import evidence


def test_overlaps_once(spark):
    rnd = random.Random(1)
    a = [(rnd.choice("xy"), i, lo := rnd.randint(0, 300), lo + rnd.randint(-2, 90)) for i in range(60)]
    b = [(rnd.choice("xy"), i, lo := rnd.randint(0, 300), lo + rnd.randint(0, 90)) for i in range(60)]
    l, r = spark.createDataFrame(a, "k string, i int, lo int, hi int"), spark.createDataFrame(b, "k string, j int, lo2 int, hi2 int")
    a += [("x", 100, 0, 1 << 40), ("y", 101, None, 5), ("y", 102, 7, 7)]
    b += [("x", 100, -5, 1 << 35), ("x", 101, 299, 300), ("y", 102, 7, 1000)]
    l, r = spark.createDataFrame(a, "k string, i int, lo long, hi long"), spark.createDataFrame(b, "k string, j int, lo2 long, hi2 long")
    got = [(x.i, x.j) for x in evidence.overlapping(l, r, ["k"], "lo", "hi", "lo2", "hi2", 25).collect()]
    want = [(i, j) for k, i, lo, hi in a for q, j, lo2, hi2 in b if k == q and lo is not None and lo <= hi and lo <= hi2 and lo2 <= hi]
    assert sorted(got) == sorted(want)


def test_budget_and_cursor():
    answer = {"keep": "x" * 20, "a": list(range(30)), "b": list(range(30))}
    out, lost = evidence.trim(answer, ["a", "b"], 100)
    assert len(evidence.canonical(out)) <= 100 and out["keep"] == answer["keep"] and lost["a"] == 30 and out["b"] == answer["b"][: len(out["b"])]
    with pytest.raises(ValueError):
        evidence.trim(answer, ["a"], 60)
    c = evidence.make_cursor({"offset": 5}, b"k")
    assert evidence.read_cursor(c, b"k") == {"offset": 5}
    with pytest.raises(ValueError):
        evidence.read_cursor(c, b"other")


def test_targets_and_parts(spark):
    body = "pre\r\n--B-1\r\nContent-Type: application/json\r\n\r\n{}\r\n--B-1\r\nContent-Id: n\r\n\r\nx\r\ny\r\n--B-1--\r\n"
    df = spark.createDataFrame(
        [([(":path", "/p"), (":Authority", "h")], body, 'multipart/related; boundary="B-1"', '{"a":{"b":"7"}}'), ([(":path", "/p")], body, "text/plain", "broken"), (None, None, None, None)],
        "h array<struct<name string, value string>>, body string, kind string, tree string",
    )
    got = df.select(http.target(F.col("h")).alias("t"), http.parts(F.col("body"), F.col("kind")).alias("p"), http.tree_value(F.col("tree"), "a.b", "int").alias("v")).collect()
    assert [r.t for r in got] == ["http://h/p", "/p", None]
    assert [tuple(x) for x in got[0].p] == [("application/json", "{}"), (None, "x\r\ny")] and got[1].p is None and got[2].p is None
    assert [r.v for r in got] == [7, None, None]
