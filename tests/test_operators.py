import hashlib
import hmac
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sigtrace.functions import ids, text
from sigtrace.operators import attempts, identity, joins, ordered, ranking
from sigtrace.operators.components import smallest_labels
from sigtrace.operators.match import EventMatcher, any_matcher, condition
from sigtrace.operators.phases import sweep
from sigtrace.operators.skew import join_hot
from sigtrace.plans import captures, events
from sigtrace.sources.jsonl import authorised, read_documents, read_lines, read_records, split_lines
from sigtrace.sources.shared import RunFolder
from sigtrace.sources.sinks import publish, verify
from sigtrace.streaming.sessions import run_sessions, sessions


def test_uuid_and_mask(spark):
    df = spark.createDataFrame([("a", 1), ("é", None)], "a string, b int")
    space, key = uuid.uuid4(), ids.run_key(b"k" * 80, "run")
    got = df.select(ids.uuid5(space, F.col("a"), F.col("b")), ids.mask(F.lit("supi"), F.col("a"), key)).collect()
    assert got[0][0] == str(uuid.uuid5(space, "a\x1f1")) and got[1][0] is None
    assert [r[1] for r in got] == ["supi:mask_" + hmac.new(key, f"supi:{a}".encode(), hashlib.sha256).hexdigest()[:24] for a in "aé"]


def test_texts(spark):
    df = spark.createDataFrame([("https://h/nudm-sdm/v1/sm-contexts/7?x=1&x=2%20&y", "Zone-A b"), (None, None), ("", "")], "u string, t string")
    rows = df.select(text.url_path(F.col("u")).alias("p"), text.url_query(F.col("u")).alias("q"), text.after_segment(text.url_path(F.col("u")), "sm-contexts").alias("c"), text.normal_key(F.col("t")).alias("k"), text.holds_tokens(F.lit("B zone"), F.col("t")).alias("h")).collect()
    assert rows[0].p == "/nudm-sdm/v1/sm-contexts/7" and [tuple(x) for x in rows[0].q] == [("x", "1"), ("x", "2 "), ("y", "")] and rows[0].c == "7" and rows[0].k == "zoneab" and rows[0].h
    assert rows[1].p is None and rows[1].q == [] and not rows[1].h and rows[2].p is None


def test_first_values(spark):
    df = spark.createDataFrame([('{"x":{"AMF-UE-NGAP-ID":["7"]},"b":"{\\"ran_ue_ngap_id\\":0.5}","a":{"amfUeNgapId":"8"}}',), ("not json",), (None,), ('[{"amfuengapid":null},{"amfuengapid":true}]',)], "t string")
    got = df.select(text.first_values(F.col("t"), {"amf": ["amf_ue_ngap_id"], "ran": ["ranuengapid"]}).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [("7", "0.5"), (None, None), (None, None), ("true", None)]


def test_matchers_and_conditions(spark):
    df = spark.createDataFrame([("NAS", "A", "x", "1"), ("PFCP", "B", None, ""), (None, None, None, None)], "protocol string, message_type string, outcome string, pdu string")
    m = [EventMatcher("NAS", ("A",), ("x",), {"pdu": "1"}, ("pdu",)), EventMatcher(identifier_present=("pdu",), protocol="PFCP"), EventMatcher(attribute_equals={"outcome": None}, message_types=("B",))]
    assert [r[0] for r in df.select(any_matcher(m)).collect()] == [True, True, False]
    assert [r[0] for r in df.select(any_matcher([])).collect()] == [False] * 3
    c = {"op": "or", "children": [{"op": "absent", "fact": "pdu"}, {"op": "in", "fact": "p", "value": ["NAS"]}, {"op": "eq", "fact": "unknown", "value": 1}]}
    assert [r[0] for r in df.select(condition(c, {"pdu": F.col("pdu"), "p": F.col("protocol")})).collect()] == [True, None, True]
    deep = {"op": "present", "fact": "p"}
    for _ in range(9):
        deep = {"op": "not", "children": [deep]}
    with pytest.raises(ValueError):
        condition(deep, {"p": F.lit(1)})


def test_joins_by_time(spark):
    rnd = random.Random(1)
    points = [(rnd.choice("ab"), rnd.randint(0, 500), i) for i in range(200)] + [(None, 3, 900), ("a", None, 901)]
    spans = [(rnd.choice("ab"), lo := rnd.randint(0, 500), rnd.choice([None, lo + rnd.randint(-3, 60)]), i) for i in range(50)]
    p, s = spark.createDataFrame(points, "k string, t long, i long"), spark.createDataFrame(spans, "k string, lo long, hi long, j long")
    got = {(r.i, r.j) for r in joins.in_interval(p, s, ["k"], "t", "lo", "hi", 17).collect()}
    assert got == {(i, j) for k, t, i in points for q, lo, hi, j in spans if k == q and t is not None and lo <= t and (hi is None or t <= hi)}
    found = {r.i: r.as_of_j for r in joins.last_before(p, s, ["k"], "t", "lo", ["j"], width=13).collect()}
    assert found == {i: max(((lo, j) for k2, lo, _, j in spans if k2 == k and t is not None and lo <= t), default=(0, None))[1] for k, t, i in points}
    near = joins.around(spark.createDataFrame([(100, 1), (103, 2)], "a long, n int"), p.select("t", "i"), "a", "t", 5, 2)
    assert {(r.n, r.i) for r in near.collect()} == {(n, i) for a, n in ((100, 1), (103, 2)) for _, t, i in points if t is not None and a - 5 <= t <= a + 2}


def test_neighbours_over_blocks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), t, rnd.randint(0, 9)) for t in rnd.sample(range(3000), 300)]
    df = spark.createDataFrame(rows, "k string, t long, v int")
    block = F.floor(F.col("t") / 100)
    x = ordered.with_position(df, ["k"], block, ["t"], "pos")
    x = ordered.with_neighbour(x, ["k"], block, ["t"], F.col("v"), "before")
    x = ordered.with_neighbour(x, ["k"], block, ["t"], F.col("v"), "after", after=True)
    x = ordered.with_neighbours(ordered.with_running_sum(x, ["k"], block, ["t"], F.col("v"), "total"), ["k"], "t", 64)
    got = {(r.k, r.t): (r.pos, r.before, r.after, r.total, r.t_before, r.t_after) for r in x.collect()}
    want = {}
    for k in ("a", "b", None):
        q = sorted(r for r in rows if r[0] == k) if k else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        for i, (_, t, v) in enumerate(q):
            b, a = (q[i - 1] if i else (0, None, None)), (q[i + 1] if i + 1 < len(q) else (0, None, None))
            want[k, t] = (i + 1, b[2], a[2], sum(r[2] for r in q[: i + 1]), b[1], a[1])
    assert got == want


def test_hot_join_spreads(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(600)] + [("gone", 1), (None, 2)]
    facts = [("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(0, 600, 3)]
    r, f = spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame(facts, "k string, fact string")
    out = join_hot(r, f, "k", "fact", "i", hot_rows=50)
    assert {(x.k, x.i, x.fact) for x in out.collect()} == {(k, i, dict(facts).get(k)) for k, i in rows} and out.count() == len(rows)
    sized = f.join(r.groupBy("k").agg(F.count("*").alias("size")), "k")
    assert sorted(map(str, join_hot(r, sized, "k", "fact", "i", hot_rows=50).collect())) == sorted(map(str, out.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_hot(r, f, "k", "fact", "i", hot_rows=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    line = next(x for x in plan.splitlines() if "SortMergeJoin" in x)
    assert "_at" in line


def test_attempts_against_a_loop(spark):
    rnd = random.Random(3)
    profiles = [attempts.Profile("p", ("t",), ("ok",), ("bad",), 50, ("s",)), attempts.Profile("q", ("s",), ("t",), ("bad",), 80)]
    rows = [(rnd.choice(["a", "b"]), i, i * 10 + rnd.choice([0, 0, 60]) * (i % 5 == 0), rnd.choice(["t", "s", "ok", "bad", "z"])) for i in range(200)]
    end = 2100
    want = []
    for who in "ab":
        live = {}
        for _, f, t, kind in [r for r in rows if r[0] == who]:
            for p in profiles:
                a = live.get(p.profile_id)
                if a and t - a[3] > p.timeout:
                    want.append((who, p.profile_id, a[0], a[1], a[4], "timed_out"))
                    del live[p.profile_id]
            for p in profiles:
                if kind in p.triggers and p.profile_id not in live:
                    live[p.profile_id] = [f, f, t, t, 0]
            for p in profiles:
                a = live.get(p.profile_id)
                if a and kind in p.triggers + p.stages + p.success + p.failure:
                    a[1], a[3], a[4] = f, t, a[4] + 1
                    if kind in p.success + p.failure:
                        want.append((who, p.profile_id, a[0], a[1], a[4], "succeeded" if kind in p.success else "failed"))
                        del live[p.profile_id]
        for p in profiles:
            if p.profile_id in live:
                a = live[p.profile_id]
                want.append((who, p.profile_id, a[0], a[1], a[4], "timed_out" if end - a[3] > p.timeout else "incomplete_capture"))
    df = spark.createDataFrame(rows, "subject string, frame long, time long, message_type string")
    got = attempts.segment_attempts(df, profiles, end).collect()
    assert sorted((r.subject, r.profile_id, r.start_frame, r.end_frame, r.n_events, r.outcome) for r in got) == sorted(want)
    assert attempts.segment_attempts(df.limit(0), profiles, end).count() == 0


def test_pages_and_digests(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), i, rnd.choice([3, 5, 40])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, n int")
    got = {(r.k, r.i): r.page for r in ranking.pages(df, ["k"], ["i"], F.col("n"), 20, 4).collect()}
    want = {}
    for k in "ab":
        page = used = n = 0
        for _, i, s in [r for r in rows if r[0] == k]:
            if n and (used + s > 20 or n >= 4):
                page, used, n = page + 1, 0, 0
            used, n = used + s, n + 1
            want[k, i] = page
    assert got == want
    d = {r.k: r.digest for r in ranking.ordered_digest(df, "k", ["i"], "n").collect()}
    assert d["a"] == hashlib.sha256("\n".join(hashlib.sha256(str(s).encode()).hexdigest() for k, _, s in rows if k == "a").encode()).hexdigest()


def test_ranks_and_alignment(spark):
    c = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("a", 3, 0.5), ("a", 4, 0.2), ("b", 5, 0.3)], "k string, i int, s double").withColumn("score", ranking.clamped_sum([F.col("s"), F.lit(None), F.lit("0.00005")]))
    got = [(r.i, str(r.score), r.candidate_rank, r.classification) for r in ranking.rank(c, ["k"], "score", [F.col("i")], 0.45, 0.15).orderBy("i").collect()]
    assert got == [(1, "0.9000", 1, "primary"), (2, "0.8000", 2, "alternative"), (3, "0.5000", 3, "downstream")]
    l, r = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int"), spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 1)], "k string, v int")
    assert {x.k: x.relation for x in joins.compare(l, r, ["k"], "v").collect()} == {"a": "matched", "b": "changed", "c": "matched", "d": "extra"}


def test_sweep_covers_all(spark):
    spans = [(10, 20), (15, 40), (60, 60), (200_000, 200_050)]
    df = spark.createDataFrame(spans, "a long, b long")
    rows = sorted(sweep(df, "a", "b", 2, 0, 300_000).collect())
    assert [(r.from_frame, r.to_frame, r.n_active) for r in rows] == [(0, 7, 0), (8, 12, 1), (13, 22, 2), (23, 42, 1), (43, 57, 0), (58, 62, 1), (63, 199_997, 0), (199_998, 200_052, 1), (200_053, 300_000, 0)]
    assert [r.phase for r in rows] == ["capture_preamble", "attempt_active", "attempt_active", "attempt_active", "between_attempts", "attempt_active", "between_attempts", "attempt_active", "capture_postamble"]
    assert [tuple(r)[:3] for r in sweep(df.limit(0), "a", "b", 2, 0, 9).collect()] == [(0, 9, 0)]


def test_labels_of_key_graphs(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40) if i % 9] + [("z", "z"), ("z", None), ("b", "a"), ("a", "b")]
    got = {r.v: r.label for r in smallest_labels(spark.createDataFrame(edges, "a string, b string"), RunFolder(spark, "t")).collect()}
    assert got["a"] == got["b"] == "a" and got["z"] == "z" and got["n09"] == "n01" and got["n18"] == "n10" and got["n40"] == "n37"


def test_identifiers_and_conflicts(spark):
    e = spark.createDataFrame([(1, "s1", None), (2, "s2", "9"), (3, "", "9")], "event_id int, supi string, sm_context_ref string")
    long = identity.to_long(e, ["event_id"], ["supi", "sm_context_ref"])
    assert {tuple(r) for r in long.select("event_id", "kind", "lookup_value", identity.node_type(F.col("kind"))).collect()} == {(1, "supi", "s1", "UE"), (2, "supi", "s2", "UE"), (2, "sm_context_ref", "9", "SM_CONTEXT"), (3, "sm_context_ref", "9", "SM_CONTEXT")}
    b = spark.createDataFrame([("x", "u", 2), ("x", "t", 1), ("y", "u", 1), ("y", None, 0)], "a string, b string, f int")
    assert [tuple(r) for r in identity.conflicts(b, "a", "b", [F.col("f")]).collect()] == [("x", 2, "t")]


def test_linked_counts_all_kinds(spark):
    rnd = random.Random(5)
    kinds = ["supi", "suci", "guti", "amf_ue_ngap_id", "ran_ue_ngap_id", "pdu_session_id", "sm_context_ref", "cp_seid", "up_seid"]
    rows = sorted({(e, rnd.choice(kinds), str(rnd.randint(0, 30))) for e in (1, 1, 1, 2, 3, 4) for _ in range(20)})
    node = lambda k: next((t for t, ks in identity.NODE_TYPES.items() if k in ks), "PFCP_SESSION")
    want = {}
    for e in range(1, 5):
        group = sorted((node(k), k, v) for x, k, v in rows if x == e)
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if a[0] != b[0] or a[0] == "ACCESS_CONTEXT":
                    want[e, a[1], b[1]] = want.get((e, a[1], b[1]), 0) + 1
    got = {(r.event_id, r.left_kind, r.right_kind): r.n_pairs for r in identity.linked(spark.createDataFrame(rows, "event_id int, kind string, lookup_value string"), "event_id", "kind").collect()}
    assert got == want and any(k[1:] == ("amf_ue_ngap_id", "amf_ue_ngap_id") for k in got)


def test_cooccurrence_pairs_over_all_kinds(spark, data):
    got = {(r.left_kind, r.right_kind) for r in captures.cooccurrence_pairs(spark, data).collect()}
    assert {("cp_seid", "guti"), ("pdu_session_id", "sm_context_ref"), ("ran_ue_ngap_id", "supi")} <= got


def test_pfcp_transactions_of_all_messages(spark, tmp_path):
    a, b, c = "10.0.0.1", "10.0.0.2", "10.0.0.3"
    rows = [  # frame, src, dst, type, sequence, seid, response_to, tree
        (1, a, b, "50", "7", "0x0a", None, '{"pfcp.seid":"0x0a"}'),
        (2, b, a, "0x33", "7", "10", "", '{"cause":"1"}'),
        (3, a, c, "50", "7", "10", "None", "{}"),  # another peer with the same sequence
        (4, a, b, "50", "7", "11", None, "{}"),  # another session
        (5, b, a, "57", "8", None, "99", '{"x":"{\\"cause\\":\\"65\\"}"}'),
        (6, c, a, "57", "9", "5", "99", '{"cause":"1"}'),
        (7, a, b, "1", "12", None, None, "{}"),
        (8, b, a, "2", "0x0c", None, None, None),
        (9, a, b, "5", "13", None, None, '{"pdu_session_id":"3"}'),
        (10, b, a, "6", "13", None, None, '{"pdu_session_id":"3","cause":"1"}'),
        (11, a, None, None, None, None, None, '{"cause":"64", cut'),
    ]
    schema = "frame long, src_ip string, dst_ip string, msg_type string, seq_num string, seid string, response_to string, pfcp string"
    df = spark.createDataFrame(rows, schema).select("*", F.struct("src_ip", "dst_ip").alias("transport"), F.lit("x").alias("analysis_id"))
    df.write.parquet(str(tmp_path / "pfcp_messages.parquet"))
    got = {(r.response_to, r.node_pair, r.seq, r.seid): (r.n_messages, r.first_frame, r.n_responses, r.outcome) for r in captures.pfcp_transactions(spark, str(tmp_path)).collect()}
    ab, ac = f"{a}->{b}", f"{a}->{c}"
    assert got == {
        (None, ab, "7", "10"): (2, 1, 1, "success"),
        (None, ac, "7", "10"): (1, 3, 0, "unknown"),
        (None, ab, "7", "11"): (1, 4, 0, "unknown"),
        ("99", None, None, None): (2, 5, 2, "failure"),
        (None, ab, "12", None): (2, 7, 1, "unknown"),
        (None, ab, "13", "3"): (2, 9, 1, "success"),
        (None, None, None, None): (1, 11, 0, "failure"),
    }


def test_phases_sweep_all_attempts(spark, data):
    spans = [(r.start_frame, r.end_frame) for r in events.attempt_segments(spark, data).collect()]
    last = max(b for _, b in spans)
    first = min(a for a, _ in spans)
    for r in events.phase_sweep(spark, data).collect():
        for f in (r.from_frame, r.to_frame):
            n = sum(max(a - 20, first) <= f <= min(b + 20, last) for a, b in spans)
            assert (r.n_active, r.phase == "attempt_active") == (n, n > 0)
    assert events.event_phases(spark, data).filter("phase != 'attempt_active'").count() == 0  # each event is of an attempt


def test_identity_conflicts_of_all_kinds(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for _ in range(500):
        e, kind = rnd.choice([1, 1, 1, *range(2, 40)]), rnd.choice(["amf_ue_ngap_id", "ran_ue_ngap_id", "supi", "suci", "guti", "cp_seid"])
        rows.append((f"e{e}", kind, str(rnd.randint(0, 60)), rnd.choice(["s", "t", None]) if "ngap" in kind else "u", rnd.randint(0, 99)))
    df = spark.createDataFrame(rows, "event_id string, kind string, lookup_value string, scope_key string, frame long")
    df.write.parquet(str(tmp_path / "identity_observations.parquet"))
    bound = {}
    for e, kind, v, scope, _ in rows:
        if "ngap" in kind:
            frame = min(r[4] for r in rows if r[:4] == (e, kind, v, scope))
            for x in rows:
                if x[0] == e and x[1] in ("supi", "suci", "guti"):
                    bound.setdefault((kind, v, scope, x[1]), set()).add((frame, x[2]))
    want = {(*k, n, min(b)[1]) for k, b in bound.items() if (n := len({v for _, v in b})) > 1}
    got = [tuple(r) for r in captures.identity_conflicts(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and len({(k[0], k[3]) for k in want}) == 6


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"a":1}\n\nbroken\n[1]\n{"a":2}\n{"a":3} more\n')
    lines = split_lines(read_lines(spark, str(tmp_path / "in")))
    assert sorted(r.state for r in lines.collect()) == ["blank", "not_json", "not_json", "not_object", "ok", "ok"]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert sorted(r.a for r in read_records(spark, str(tmp_path / "in"), schema).filter("_corrupt_record is null and a is not null").collect()) [:2] == [1, 2]
    with pytest.raises(Exception):
        read_records(spark, str(tmp_path / "in"), schema, strict=True).collect()
    assert [r.valid for r in read_documents(spark, str(tmp_path / "in")).collect()] == [False]
    t = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    publish({"t": t, "e": t.limit(0)}, str(tmp_path / "out"), by={"t": ["i"]})
    assert verify(spark, str(tmp_path / "out")) == {"t": True, "e": True}
    with pytest.raises(ValueError):
        publish({"t": t}, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        publish({"../t": t}, str(tmp_path / "out2"))
    with pytest.raises(Exception):
        authorised(t, F.col("i") < 2).collect()


def test_sessions_in_batch(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2026-01-01 00:00:00'), (1, TIMESTAMP'2026-01-01 00:05:00'), (1, TIMESTAMP'2026-01-01 01:00:00'), (2, TIMESTAMP'2026-01-01 00:01:00') t(u, ts)")
    assert sorted((r.u, r.n_events) for r in sessions(df, "u", "ts", "10 minutes", "1 hour").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_run_sessions_keeps_late_and_open_ones(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.randint(0, 3000)) for _ in range(300)] + [(9, 0), (9, 10), (9, 20), (9, 31)]  # minutes
    rnd.shuffle(rows)
    for i in range(6):  # the last file's events are late for all others
        part = rows[i::6] + [(7, 5000 - 900 * i), (8, 1000 - 5 * i)]
        spark.createDataFrame(part, "u int, m long").select("u", F.timestamp_seconds(F.col("m") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("u int, ts timestamp").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "e"))
    whole = spark.read.parquet(str(tmp_path / "e"))
    want, by = [], {}
    for r in whole.select("u", (F.unix_seconds("ts") / 60).cast("long").alias("m")).collect():
        by.setdefault(r.u, []).append(r.m)
    for u, ms in by.items():
        ms.sort()
        cuts = [0, *[i for i in range(1, len(ms)) if ms[i] - ms[i - 1] > 10], len(ms)]
        want += [(str(u), ms[a], ms[b - 1], b - a) for a, b in zip(cuts, cuts[1:])]
    flat = lambda s: sorted((str(r.u), int(r.start.timestamp()) // 60, int(r.last.timestamp()) // 60, r.n_events) for r in s.collect())
    folder = RunFolder(spark, "t")
    assert flat(sessions(whole, "u", "ts", "10 minutes", "1 hour")) == sorted(want)
    assert flat(run_sessions(stream, "u", "ts", "10 minutes", folder)) == sorted(want)
    assert flat(run_sessions(stream, "u", "ts", "10 minutes", folder)) == sorted(want)  # goes on where it stopped
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema("u int, ts timestamp").parquet(str(tmp_path / "none"))
    assert run_sessions(none, "u", "ts", "10 minutes", RunFolder(spark, "t")).count() == 0


def test_causes_by_message_words_first(spark):
    rows = [
        ("REGISTRATION_REJECT", None, None, "failure"), ("REGISTRATION_REJECT", "unknown", "", "failure"), ("PAGING_FAILURE", "success", "normal", "failure"), ("REGISTRATION_ACCEPT", None, "17", "success"),
        ("STATUS", "success", "17", "success"), ("STATUS", None, "normal", "success"), ("STATUS", None, "17", "failure"), ("STATUS", None, "none", "unknown"), ("STATUS", "failure", None, "failure"), (None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "m string, o string, c string, want string")
    assert all(r[0] == r.want for r in df.select(text.cause_class(F.col("m"), F.col("o"), F.col("c")), "want").collect())


def test_intervals_of_any_length_and_valid_counts(spark):
    rnd = random.Random(8)
    spans = [(rnd.choice("ab"), rnd.randint(0, 900), None if rnd.random() < 0.3 else rnd.randint(0, 1 << 30) if rnd.random() < 0.2 else rnd.randint(0, 1000), f"v{i:03}") for i in range(120)] + [("a", None, 5, "x"), (None, 1, 9, "y")]
    points = [(rnd.choice("ab"), rnd.randint(0, 1100)) for _ in range(150)] + [("a", None), (None, 4), ("c", 1)]
    s = spark.createDataFrame(spans, "k string, lo long, hi long, v string")
    p = spark.createDataFrame(points, "k string, t long").distinct()
    holds = lambda pt, sp: None not in (pt[0], pt[1], sp[0], sp[1]) and pt[0] == sp[0] and sp[1] <= pt[1] and (sp[2] is None or pt[1] <= sp[2])
    want = {(pt[0], pt[1], sp[3]) for pt in points for sp in spans if holds(pt, sp)}
    assert {(r.k, r.t, r.v) for r in joins.in_interval(p, s, ["k"], "t", "lo", "hi", 16).collect()} == want
    counts = {(r.k, r.t): (r.n_valid, r.first_valid) for r in joins.valid_counts(p.filter("k is not null"), s.filter("k is not null"), ["k"], "t", "lo", "hi", "v", 16).collect()}
    assert counts == {k: (len(vs), min(vs)) for k in {w[:2] for w in want} for vs in [[w[2] for w in want if w[:2] == k]]}
    last = {(r.k, r.t): r.v for r in joins.latest_valid(p, s, ["k"], "t", "lo", "hi", F.col("v"), 16, ["k", "t"]).collect()}
    start = {sp[3]: sp[1] for sp in spans}
    assert last == {k: min((w[2] for w in want if w[:2] == k), key=lambda v: (-start[v], v)) for k in {w[:2] for w in want}}
    assert joins.in_interval(p.limit(0), s, ["k"], "t", "lo", "hi", 16).count() == 0 == joins.in_interval(p, s.limit(0), ["k"], "t", "lo", "hi", 16).count()


def test_star_edges_connect_all_keys_of_an_event(spark):
    rows = [(1, "a"), (1, "c"), (1, "b"), (1, "a"), (2, "c"), (2, "d"), (3, "z"), (None, "q"), (4, None)]
    got = sorted(map(tuple, identity.star(spark.createDataFrame(rows, "e int, k string"), "e", "k").collect()))
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("c", "c"), ("c", "d"), ("z", "z")]


def test_scopes_roles_and_nodes_of_events(spark):
    df = spark.createDataFrame([("supi", "1", "x", "y", 5), ("amf_ue_ngap_id", "1", "x", None, 5), ("pdu_session_id", None, "x", "y", 5), ("ue_ip", None, None, None, 5)], "kind string, access string, src string, dst string, frame long")
    got = [(r[0], r[1]) for r in df.select(identity.scope_key(*[F.col(c) for c in df.columns]), identity.role(F.col("kind"))).collect()]
    assert got == [("supi:subscriber", "UE"), ("amf_ue_ngap_id:x:unknown", "ACCESS_CONTEXT"), ("pdu_session_id:access:unknown", "SESSION"), ("ue_ip:frame:5", "USER_PLANE")]
    events = spark.createDataFrame([(1,), (2,), (2,)], "event_id int")
    obs = spark.createDataFrame([(1, "o1"), (1, "o2"), (1, "o3")], "event_id int, observation_id string")
    members = spark.createDataFrame([("o1", "n1", "UE"), ("o2", "n1", "UE"), ("o3", "n2", "PDU_SESSION")], "observation_id string, node_id string, node_type string")
    assert sorted(map(tuple, identity.nodes_of_events(events, obs, members).collect()), key=str) == [(1, "n1", "UE"), (1, "n2", "PDU_SESSION"), (2, None, None)]


def test_running_aggregates_over_blocks(spark):
    rnd = random.Random(2)
    rows = [("h" if i % 5 else "g", i, rnd.randint(-5, 5) if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, v int")
    from sigtrace.operators.ordered import running

    got = {(r.k, r.t): (r.s, r.m) for r in running(df, ["k"], F.floor(F.col("t") / 16), ["t"], {"s": (F.sum, F.col("v")), "m": (F.min, F.col("v"))}).collect()}
    for k, t, _ in rows:
        seen = [v for a, b, v in rows if a == k and b <= t and v is not None]
        assert got[k, t] == ((sum(seen), min(seen)) if seen else (None, None))
