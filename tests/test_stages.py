import pytest
from pyspark.sql import functions as F

from sigtrace.functions import messages as M
from sigtrace.operators import stages as S
from sigtrace.operators.transactions import http_failures, transaction_key

FACTS = lambda: {"kind": F.col("kind")}


def states(spark, seen, rules, attempts=((1, 0, False, "x", True),), explained=(), requested=()):
    a = spark.createDataFrame(list(attempts), "id int, start_time long, incomplete_history boolean, kind string, visible boolean")
    s = spark.createDataFrame(list(seen), "id int, stage_id string, frame long, time long")
    pair = lambda rows: spark.createDataFrame(list(rows), "id int, stage_id string")
    got = S.stage_results(a, s, rules, ["id"], FACTS(), pair(explained), pair(requested))
    return {(r.id, r.stage_id): (r.state, r.reason) for r in got.collect()}


def test_predecessors_conditions_and_evidence(spark):
    rules = [
        S.StageRule("a", 0, timeout=5), S.StageRule("b", 1, predecessors=("a",)), S.StageRule("c", 2, predecessors=("b",)), S.StageRule("d", 3, "optional"), S.StageRule("e", 4, "conditional", condition={"op": "eq", "fact": "kind", "value": "y"}),
        S.StageRule("f", 5, condition={"op": "eq", "fact": "none", "value": 1}), S.StageRule("g", 6, visible=("visible",)), S.StageRule("h", 7), S.StageRule("i", 8, terminal_success=True), S.StageRule("j", 9),
    ]
    got = states(spark, [(1, "a", 4, 6), (1, "a", 3, 2), (2, "a", 9, 3)], rules, [(1, 0, False, "x", False), (2, 0, True, None, True)], [(1, "b"), (1, "c")], [(1, "h"), (1, "i")])
    assert [got[1, s] for s in "abcdefghij"] == [
        ("completed", "deadline_missed"), ("suppressed", "explicit_evidence"), ("skipped", "predecessor_not_reached"), ("skipped", "optional_stage"), ("skipped", "condition_false"), ("skipped", "fact_unknown"),
        ("skipped", "not_visible"), ("suppressed", "request_only"), ("missing", "required_stage"), ("missing", "required_stage"),
    ]
    assert got[2, "a"] == ("completed", "observed_stage") and got[2, "b"] == ("skipped", "history_incomplete") and got[2, "e"] == ("skipped", "fact_unknown")
    for bad in ([S.StageRule("a", 0, predecessors=("b",)), S.StageRule("b", 1)], [S.StageRule("a", 0), S.StageRule("a", 1)], [S.StageRule("a", 0, predecessors=("zz",))]):
        with pytest.raises(ValueError):
            S.check_dag(bad)
    assert states(spark, [], rules, []) == {}


def test_orderings(spark):
    rows = [(1, "x", 1), (1, "z", 2), (1, "y", 3), (1, "y", 9), (2, "x", 1), (2, "y", 2), (2, "x", 3), (3, "y", 1), (3, "x", 2), (4, "x", 1), (1, "x", 2), (1, "x", 2)]
    demands = [S.Ordering("b", "before", "x", "y"), S.Ordering("i", "immediately_before", "x", "y"), S.Ordering("n", "at_least_n_between", "x", "y", n=3), S.Ordering("f", "no_forbidden_between", "x", "y", forbidden=("z",))]
    got = {(r.id, r.name): r.verdict for r in S.orderings(spark.createDataFrame(rows, "id int, checkpoint string, frame long"), ["id"], demands).collect()}
    assert [got[1, n] for n in "binf"] == [True, False, True, False] and [got[2, n] for n in "binf"] == [True, True, False, True]
    assert [got[3, n] for n in "binf"] == [False] * 4 and [got[4, n] for n in "binf"] == [None] * 4


def test_checkpoints_and_folding(spark):
    rows = [(1, "NAS", "REGISTRATION_REQUEST initial", 5, "v1", True), (1, "NAS", "REGISTRATION REQUEST", 9, "v2", True), (2, "NAS", "other", 5, None, True), (3, "NAS", "other", 5, None, False), (4, None, None, None, "", None)]
    df = spark.createDataFrame(rows, "id int, protocol string, message_type string, frame long, value string, seen boolean")
    c = [S.Checkpoint("s", "reg", "NAS", "request registration", frames=(0, 9)), S.Checkpoint("s", "bad", message="other", forbidden=True), S.Checkpoint("t", "none", fields=(("value", "absent", None), ("message_type", "eq", "other")))]
    got = {(r.id, r.name): r.verdict for r in S.checkpoint_verdicts(df, c, ["id"], F.col("seen"), "value").collect()}
    assert [got[i, "reg"] for i in (1, 2, 3, 4)] == ["inconclusive", "failed", "inconclusive", "inconclusive"]
    assert [got[i, "bad"] for i in (1, 2, 3, 4)] == ["passed", "failed", "failed", "inconclusive"] and got[2, "none"] == "passed"
    folded = {(r.id, r.scenario): r.status for r in S.fold_verdicts(S.checkpoint_verdicts(df, c, ["id"], F.col("seen")), ["id"]).collect()}
    assert folded[1, "s"] == "passed" and folded[2, "s"] == "failed" and folded[4, "s"] == "inconclusive"


def test_fields_sets_and_earlier_events(spark):
    df = spark.createDataFrame([(1, 2, "b", None), (1, 1, None, None), (1, 3, "a", None), (2, 1, "c", "d")], "id int, o int, x string, y string")
    got = {(r.id, r.field): (r.value, r.n_values, r.status) for r in S.request_fields(df, ["id"], ["x", "y"], ["o"]).collect()}
    assert got == {(1, "x"): ("b", 2, "conflict"), (1, "y"): (None, 0, "missing"), (2, "x"): ("c", 1, "decoded"), (2, "y"): ("d", 1, "decoded")}
    sets = spark.createDataFrame([("k", ["a", "b", None], [1]), ("k", ["b"], None), ("m", [], [2, 2])], "k string, s array<string>, t array<int>")
    assert sorted(map(tuple, S.merged_sets(sets, "k", ["s", "t"]).collect())) == [("k", "s", "a"), ("k", "s", "b"), ("k", "t", "1"), ("m", "t", "2")]
    e = spark.createDataFrame([("g", i, i in (3, 40)) for i in range(60)] + [("h", 1, None)], "g string, i long, bad boolean")
    got = {(r.g, r.i): r.d for r in S.with_earlier(e, ["g"], "i", F.col("bad"), "d", block=8).collect()}
    assert all(v == (k[0] == "g" and k[1] > 3) for k, v in got.items())


def test_http_failures_and_keys(spark):
    rows = [(503, "complete", None), (404, "reset", None), (200, "complete", None), (None, "reset", None), (200, "truncated", None), (None, "request_only", None), (None, "unknown", "idle_timeout"), (None, "unknown", None)]
    df = spark.createDataFrame(rows, "status int, completion string, ended string")
    got = {(r.status, r.completion, r.ended): (r.category, r.severity) for r in http_failures(df, F.col("ended")).collect()}
    assert got == {
        (503, "complete", None): ("http_status_failure", "critical"), (404, "reset", None): ("http_status_failure", "error"), (None, "reset", None): ("http_reset", "warning"), (200, "truncated", None): ("http_incomplete_capture", "warning"),
        (None, "request_only", None): ("http_timeout", "error"), (None, "unknown", "idle_timeout"): ("http_timeout", "error"), (None, "unknown", None): ("http_incomplete_capture", "warning"),
    }
    k = spark.createDataFrame([("", None, 1), (None, "b", 2), ("a", "b", 3)], "x string, y string, i int")
    assert [r[0] for r in k.select(transaction_key(F.col("x"), F.col("y"), own=F.col("i"))).collect()] == ["own:1", "b", "a"]


def test_message_functions(spark):
    df = spark.createDataFrame([("UnsuccessfulOutcome x",), ("successfulOutcome",), ("initiatingMessage",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(M.pdu_outcome(M.pdu_class(F.col("t")))).collect()] == ["failure", "success", "request", "unknown", "unknown"]
    c = spark.createDataFrame([("1",), ("64",), ("65",), ("NO_RESOURCES",), ("none",), (None,), ("Accepted",)], "c string")
    assert [r[0] for r in c.select(M.reply_cause_class(F.col("c"))).collect()] == ["success", "failure", "unknown", "failure", "unknown", "unknown", "success"]
    assert [r[0] for r in c.select(M.reply_cause_class(F.col("c"), "failure")).collect()][2] == "failure"
    r = spark.createDataFrame([("7", None, '{"x":"REJECTED"}'), ("7", None, "{}"), (None, "8", "{}"), (None, None, None)], "a string, b string, t string")
    assert [x[0] for x in r.select(M.reply_outcome(F.col("a"), F.col("b"), F.col("t"))).collect()] == ["failure", "success", "request", "unknown"]
    n = spark.createDataFrame([("0x1F",), ("7",), ("x",), (None,)], "v string")
    assert [x[0] for x in n.select(M.first_int(F.col("v"))).collect()] == [31, 7, None, None]
    t = spark.createDataFrame([("日本語テキスト",), ("abc",), (None,)], "t string")
    assert [x[0] for x in t.select(M.cut_text(F.col("t"), 4)).collect()] == ["日本語…", "abc", None]
