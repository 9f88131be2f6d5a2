import itertools
import random
from decimal import Decimal

import numpy as np
import pytest

from sigtrace.llm.queries import p1_collapsed, pfcp_once
from sigtrace.llm.runs import Segmenter, collapse_runs, safe_cuts, segment
from sigtrace.sources.shared import RunFolder


def cost(codes, weights, starts, penalty, mismatch):
    total = 0.0
    for a, b in zip(starts, [*starts[1:], len(codes)]):
        counts = {}
        for i in range(a, b):
            key = ("only", i) if codes[i] is None else codes[i]
            counts[key] = counts.get(key, 0) + weights[i]
        total += penalty + mismatch * (sum(counts.values()) - max(counts.values()))
    return total


@pytest.mark.parametrize("penalty,mismatch", [(0.25, 1.0), (1.0, 1.0), (1.5, 1.0), (4.0, 1.0)])
def test_segmentation_is_optimal(penalty, mismatch):
    rnd = random.Random(7)
    for _ in range(60):
        n = rnd.randint(1, 9)
        codes = [rnd.choice(["a", "a", "b", None]) for _ in range(n)]
        weights = [rnd.randint(1, 3) for _ in range(n)]
        best = min(cost(codes, weights, [0, *cuts], penalty, mismatch) for k in range(n) for cuts in itertools.combinations(range(1, n), k))
        assert cost(codes, weights, segment(codes, weights, penalty, mismatch), penalty, mismatch) == pytest.approx(best)


def graded(codes, weights, starts, penalty, fields):
    """The cost of a segmentation of events with several fields, by its definition."""
    total = 0.0
    for a, b in zip(starts, [*starts[1:], len(codes)]):
        total += penalty
        for f, w in enumerate(fields):
            total += cost([c[f] for c in codes[a:b]], weights[a:b], [0], 0.0, w)
    return total


@pytest.mark.parametrize("penalty", [0.2, 1.0, 2.5])
def test_segmentation_over_fields_is_optimal(penalty):
    rnd = random.Random(9)
    for _ in range(60):
        n = rnd.randint(1, 8)
        codes = [(rnd.choice("hs"), rnd.choice(["1", "2", None])) for _ in range(n)]
        weights = [rnd.randint(1, 3) for _ in range(n)]
        best = min(graded(codes, weights, [0, *cuts], penalty, (1.0, 0.5)) for k in range(n) for cuts in itertools.combinations(range(1, n), k))
        assert graded(codes, weights, segment(codes, weights, penalty, (1.0, 0.5)), penalty, (1.0, 0.5)) == pytest.approx(best)


def test_settled_runs_are_those_of_the_whole():
    rnd = random.Random(4)
    codes = [(rnd.choice("aaab") if i // 40 % 2 else rnd.choice("bbba"),) for i in range(2000)]
    whole, parts = Segmenter(2.0, (1.0,)), Segmenter(2.0, (1.0,))
    out = []
    for i, c in enumerate(codes):
        whole.push(c, 1)
        parts.push(c, 1)
        if i % 97 == 0:
            out += parts.settled()
    assert len(parts.best) < 600  # most was given out
    assert out + parts.finish() == whole.finish()


def test_safe_cuts_cost_nothing():
    rnd = random.Random(3)
    for _ in range(80):
        codes = [(rnd.choice("ab"), rnd.choice("xxxy")) for _ in range(rnd.randint(2, 30))]
        fields = (1.0, 0.5)
        for penalty in (0.2, 0.6, 1.0):
            ones = [1] * len(codes)
            starts = [i for i in range(len(codes)) if i == 0 or codes[i] != codes[i - 1]]
            sizes = np.diff([*starts, len(codes)])
            whole = graded(codes, ones, segment(codes, None, penalty, fields), penalty, fields)
            for c in [s for s, safe in zip(starts, safe_cuts([codes[s] for s in starts], sizes, penalty, fields)) if safe]:
                parts = segment(codes[:c], None, penalty, fields) + [c + s for s in segment(codes[c:], None, penalty, fields)]
                assert graded(codes, ones, parts, penalty, fields) == pytest.approx(whole)


def runs_of(rows):
    out = []
    for e in sorted({r[0] for r in rows}, key=lambda x: (x is not None, x)):
        q = sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[2]))
        for _, g in itertools.groupby(enumerate(q), key=lambda x: x[1][3] if x[1][3] is not None else ("only", x[0])):
            g = [x for _, x in g]
            out.append((e, g[0][3], len(g), g[0][2], g[-1][2], g[-1][1] - g[0][1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_runs_across_tasks(spark, parts):
    """One sequence holds most rows, so with seven ranges it is cut and stitched."""
    rnd = random.Random(11)
    rows = []
    for i in range(1500):
        e = rnd.choice(["hot", "hot", "hot", "x", None])
        rows.append((e, Decimal(rnd.randint(0, 400)) / 10, i, rnd.choice(["a", "a", "a", "b", None])))
    df = spark.createDataFrame(rows, "who string, t decimal(20,3), frame long, event string")
    got = collapse_runs(df, ["who"], ["t", "frame"], "event", "t", ["frame"], folder=RunFolder(spark, "t"), ranges=parts)
    found = sorted(((r.who, r.event, r.n_events, r.first_frame, r.last_frame, r.duration) for r in got.collect()), key=str)
    assert found == sorted(((a, b, c, d, e, f.quantize(Decimal("0.001"))) for a, b, c, d, e, f in runs_of(rows)), key=str)


def test_near_identical_events_and_any_cut(spark):
    """With a high penalty a single other event is bridged; cutting the sequence over tasks keeps the cost."""
    rnd = random.Random(5)
    codes = [rnd.choice("aaaaaaab") if i // 60 % 2 else rnd.choice("bbbbbbba") for i in range(900)]
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(codes)], "who string, t long, event string")
    want = cost(codes, [1] * 900, segment(codes, None, 2.0, 1.0), 2.0, 1.0)
    got = sorted((r.first_time, r.last_time) for r in collapse_runs(df, ["who"], ["t"], "event", "t", [], penalty=2.0, ranges=6).collect())
    assert [a for a, _ in got] == [0, *[b + 1 for _, b in got[:-1]]] and got[-1][1] == 899
    assert cost(codes, [1] * 900, [a for a, _ in got], 2.0, 1.0) == pytest.approx(want)


@pytest.mark.parametrize("ranges", [1, 5])
@pytest.mark.parametrize("penalty", [0.2, 1.0])
def test_runs_over_fields_against_brute_force(spark, penalty, ranges):
    """Two fields of different weight, null types, several entities; a dynamic program without pruning gives the cost."""
    rnd = random.Random(21)
    fields = (1.0, 0.5)
    rows = [("hot" if i % 3 else f"e{i % 4}", i, rnd.choice("hhhhs") if i // 50 % 2 else rnd.choice("sssh"), rnd.choice(["1", "1", "1", "2", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "who string, t long, kind string, type string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = collapse_runs(df, ["who"], ["t"], {"kind": 1.0, "type": 0.5}, "t", [], penalty=penalty, ranges=ranges).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for who in {r[0] for r in rows}:
        seq = [r for r in rows if r[0] == who]
        codes, place = [r[2:] for r in seq], {r[1]: i for i, r in enumerate(seq)}
        best = [0.0]
        for t in range(1, len(codes) + 1):
            low, counts, n = float("inf"), [{}, {}], 0
            for a in range(t - 1, -1, -1):
                n += 1
                for f in range(2):
                    key = ("only", a) if codes[a][f] is None else codes[a][f]
                    counts[f][key] = counts[f].get(key, 0) + 1
                low = min(low, best[a] + penalty + sum(w * (n - max(c.values())) for w, c in zip(fields, counts)))
            best.append(low)
        mine = sorted(((place[r.first_time], place[r.last_time], r) for r in got if r.who == who), key=lambda x: x[0])
        assert [a for a, _, _ in mine] == [0, *[b + 1 for _, b, _ in mine[:-1]]] and mine[-1][1] == len(codes) - 1
        assert graded(codes, [1] * len(codes), [a for a, _, _ in mine], penalty, fields) == pytest.approx(best[-1])
        for a, b, r in mine:
            assert r.n_events == b - a + 1 and r.duration == r.last_time - r.first_time
            if b > a:
                assert r.n_unlike == sum(c != (r.kind, r.type) for c in codes[a : b + 1])


def test_messages_without_time_are_events_of_their_own(spark, data):
    all_ = p1_collapsed(spark, data)
    once = pfcp_once(spark, data)
    assert all_.agg({"n_events": "sum"}).first()[0] == once.count()
    assert all_.filter("first_time is null").count() == once.filter("time is null").count()


def test_empty_and_repeated(spark):
    schema = "who string, t long, event string, n_events long"
    assert collapse_runs(spark.createDataFrame([], schema), ["who"], ["t"], "event", "t", []).count() == 0
    df = spark.createDataFrame([("s", 1, "a", 5)] * 3 + [("s", 1, None, 6)] * 2, schema)
    got = sorted(((r.event, r[2]) for r in collapse_runs(df, ["who"], ["t"], "event", "t", ["n_events"]).collect()), key=str)
    assert got == [("a", 3), (None, 1), (None, 1)]
    with pytest.raises(ValueError):
        collapse_runs(df, ["who"], ["t"], "event", "t", [], mismatch=0)
