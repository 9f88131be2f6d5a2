import random

import pytest

from sigtrace.operators import procedures as P
from sigtrace.operators.match import EventMatcher
from sigtrace.sources.shared import RunFolder

M = lambda *types, **more: EventMatcher(message_types=types, **more)
PROFILES = [
    P.Procedure("reg", (M("REG"), M("INITIAL_REG")), (P.Stage("auth", 1, (M("AUTH"),)), P.Stage("done", 2, (M("ACCEPT"),), "succeeded"), P.Stage("ping", 3, (M("PING"),), repeatable=True)), failure=(M("REJECT"),), abort=(M("CANCEL"),), response_timeout=5),
    P.Procedure("pdu", (M("PDU"),), (P.Stage("bad", 1, (M("PDU_FAIL"),), "failed"),), success=(M("PDU_OK"),), failure=(M("REJECT"),), abort=(M("CANCEL"),), response_timeout=40, parents=("reg",)),
]
SCHEMA = "group string, seq long, event_id string, frame long, time long, message_type string, protocol string, outcome string, ue string, access string, session string, pdu string, amf string, ran string"
IDS = ["ue", "access", "session", "pdu", "amf", "ran"]


def row(seq, time, kind, ue="a", access=None, session=None, pdu=None, group="g", amf=None, ran=None):
    return (group, seq, f"e{seq:05}", seq, time, kind, "NAS", "unknown", ue, access if access else f"x{ue}", session if session else f"s{ue}", pdu, amf, ran)


def run(spark, rows, **options):
    return P.assign(spark.createDataFrame(rows, SCHEMA), PROFILES, folder=RunFolder(spark, "t"), **options)


def loop(rows, scoring=P.Scoring(), end=None):
    """One pass over all events of a group, by the definition."""
    attempts, assigned, stages = [], {}, []
    hit = lambda ms, r: any(r["message_type"] in m.message_types for m in ms)
    profiles = {p.profile_id: p for p in PROFILES}
    if end is None:
        end = max((r[4] for r in rows if r[4] is not None), default=None)
    for group in sorted({r[0] for r in rows if r[0] is not None}):
        open_ = {}
        for r in sorted((dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows if r[0] == group), key=lambda r: r["seq"]):
            def score(a):
                if a["access"] is not None and r["access"] is not None and a["access"] != r["access"]:
                    return 0
                return min(sum(w for k, w in scoring.weights.items() if a[k] is not None and a[k] == r[k]) + (5 if r["frame"] >= a["f1"] else 0), 100)

            for i, a in list(open_.items()):
                resp = profiles[a["profile"]].response_timeout
                gone, limits = (r["time"] - a["t1"], (resp, scoring.idle_timeout)) if r["time"] is not None and a["t1"] is not None else (r["frame"] - a["f1"], (1000, 2000))
                if gone > limits[0] or gone > limits[1]:
                    attempts.append((i, a["n"], "timed_out", "response_timeout" if gone > limits[0] else "idle_timeout", a["parent"]))
                    del open_[i]
            fits = sorted((p.profile_id for p in PROFILES if hit(p.triggers, r)), reverse=True)
            new = None
            if fits and not any(a["profile"] == fits[0] and score(a) >= scoring.same_attempt for a in open_.values()):
                points = 80 + (10 if r["message_type"].startswith("INITIAL_") else 0) + (5 if r["pdu"] is not None else 0)
                if points >= scoring.least_trigger:
                    new = f"{fits[0]}:{r['event_id']}"
                    inside = [(a["f0"], i) for i, a in open_.items() if a["profile"] in profiles[fits[0]].parents and all(None in (a[k], r[k]) or a[k] == r[k] for k in ("ue", "session", "access"))]
                    open_[new] = {"profile": fits[0], "f0": r["frame"], "f1": r["frame"], "t1": r["time"], "n": 0, "seen": set(), "parent": max(inside)[1] if inside else None} | {k: r[k] for k in IDS}
            if new is None:
                ranked = sorted(((score(a), i) for i, a in open_.items()), reverse=True)
                if not ranked or ranked[0][0] < scoring.least_assignment:
                    assigned[r["event_id"]] = (None, "below_threshold" if ranked else "no_open_attempt", False)
                    continue
                new = ranked[0][1]
                assigned[r["event_id"]] = (new, "best_score", len(ranked) > 1 and ranked[0][0] == ranked[1][0])
            else:
                assigned[r["event_id"]] = (new, "trigger", False)
            a, p = open_[new], profiles[open_[new]["profile"]]
            a["f1"], a["t1"], a["n"] = r["frame"], r["time"], a["n"] + 1
            outcome = None
            for st in sorted(p.stages, key=lambda s: (s.order, s.stage_id)):
                if hit(st.matchers, r) and (st.repeatable or st.stage_id not in a["seen"]):
                    a["seen"].add(st.stage_id)
                    stages.append((new, st.stage_id, r["event_id"]))
                    outcome = st.terminal or outcome
            reason = f"stage:{[s for s in stages if s[0] == new][-1][1]}" if outcome else None
            for name, ms in (("succeeded", p.success), ("failed", p.failure), ("aborted", p.abort)):
                if outcome is None and hit(ms, r):
                    outcome, reason = name, P.REASONS[name]
            if outcome:
                attempts.append((new, a["n"], outcome, reason, a["parent"]))
                del open_[new]
        for i, a in open_.items():
            late = end is not None and a["t1"] is not None and end - a["t1"] > profiles[a["profile"]].response_timeout
            attempts.append((i, a["n"], "timed_out" if late else "incomplete_capture", "response_timeout" if late else "capture_ended_before_terminal", a["parent"]))
    return sorted(attempts), assigned, sorted(stages)


def same(got, want):
    attempts, assigned, stages = want
    assert sorted((r.attempt_id, r.n_events, r.outcome, r.reason, r.parent_id) for r in got.attempts.collect()) == attempts
    assert {r.event_id: (r.attempt_id, r.reason, r.ambiguous) for r in got.assignments.collect()} == assigned
    assert sorted((r.attempt_id, r.stage_id, r.event_id) for r in got.transitions.collect()) == stages


def test_overlapping_subjects_retries_and_ends(spark):
    rows = [row(10, 10, "REG"), row(11, 11, "REG", "b"), row(12, 12, "AUTH"), row(13, 13, "AUTH", "b"), row(14, 14, "REJECT"), row(15, 15, "REG"), row(16, 16, "ACCEPT"), row(17, 60, "PING", "b"), row(18, 60, "REG", "c")]
    got = run(spark, rows)
    same(got, loop(rows))
    by = {r.attempt_id: r for r in got.attempts.collect()}
    assert by["reg:e00010"].outcome == "failed" and by["reg:e00015"].outcome == "succeeded" and by["reg:e00011"].reason == "response_timeout" and by["reg:e00018"].outcome == "incomplete_capture"
    assert [r.reason for r in got.assignments.filter("attempt_id is null").collect()] == ["no_open_attempt"]


def test_nesting_access_and_thresholds(spark):
    rows = [row(1, 1, "INITIAL_REG"), row(2, 2, "PDU"), row(3, 3, "PING", access="other"), row(4, 4, "CANCEL"), row(5, 5, "REJECT"), row(6, 6, "REG", "z"), row(7, 6, "PDU_FAIL")]
    got = run(spark, rows)
    same(got, loop(rows))
    assert {r.attempt_id: r.parent_id for r in got.attempts.collect()}["pdu:e00002"] == "reg:e00001"
    high = P.Scoring(least_trigger=90)
    same(run(spark, rows, scoring=high), loop(rows, high))
    assert run(spark, rows, scoring=P.Scoring(least_trigger=101)).attempts.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_loop(spark, seed):
    """Groups cut at silences and one pass over each whole group give the same, missing times and identities included."""
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(700):
        t += rnd.choice([0, 1, 1, 2, 3, 7, 50]) if i % 9 else rnd.choice([0, 31, 200])
        ue = rnd.choice("abcd")
        r = list(row(i, t if rnd.random() < 0.95 else None, rnd.choice(["REG", "INITIAL_REG", "AUTH", "ACCEPT", "PDU", "PDU_OK", "PDU_FAIL", "PING", "REJECT", "CANCEL", "X"]), ue, group=rnd.choice("gggh")))
        if rnd.random() < 0.2:
            r[9] = rnd.choice([None, "y"])
        if rnd.random() < 0.2:
            r[10] = None
        r[11] = rnd.choice([None, None, "1", "2"])
        r[8] = r[8] if rnd.random() < 0.9 else None
        rows.append(tuple(r))
    same(run(spark, rows), loop(rows))


def test_empty_and_without_group(spark):
    assert run(spark, [row(1, 1, "REG", group=None)]).attempts.count() == 0
    assert P.assign(spark.createDataFrame([], SCHEMA), PROFILES).assignments.count() == 0


def test_nearest_prior(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        a = rnd.randint(0, 400)
        rows.append((f"t{i:03}", rnd.choice(["p", "q"]), rnd.choice(["u", "u", "v", None]), rnd.choice(["x", "y", "z", None]), a, a + rnd.randint(0, 60)))
    df = spark.createDataFrame(rows, "attempt_id string, profile_id string, ue string, access string, start_frame long, end_frame long")
    for other in (False, True):
        for current, prior in ((["p"], ["q"]), (["p"], ["p", "q"])):
            want = {}
            for x in rows:
                if x[1] not in current or x[2] is None or other and x[3] is None:
                    continue
                found = [(y[5], y[4], y[0]) for y in rows if y[1] in prior and y[2] == x[2] and (y[4], y[0]) < (x[4], x[0]) and (not other or y[3] is not None and y[3] != x[3])]
                if found:
                    want[x[0]] = max(found)[2]
            got = P.nearest_prior(df, current, prior, "r", other, block=32)
            assert {r.left_attempt_id: r.right_attempt_id for r in got.collect()} == want
