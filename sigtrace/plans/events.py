"""Queries over the event stream: canonical events, matching, attempts, ranking, phases, timelines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.functions.ids import mask, run_key, uuid5
from sigtrace.functions.messages import speaks_of_reachability
from sigtrace.functions.text import cause_class, holds_tokens, status_class
from sigtrace.operators import attempts as A
from sigtrace.operators import joins as J
from sigtrace.operators import procedures as P
from sigtrace.operators import ranking as R
from sigtrace.operators import stages as S
from sigtrace.operators.match import EventMatcher, any_matcher, condition, partition_of
from sigtrace.operators.ordered import with_neighbour
from sigtrace.operators.phases import sweep
from sigtrace.operators.transactions import first_per_code, retry_groups, state_of, transactions
from sigtrace.sources.jsonl import authorised, select_events
from sigtrace.sources.shared import RunFolder
from sigtrace.streaming.dedup import file_stream
from sigtrace.streaming.sessions import run_sessions

SPACE = uuid.UUID("8f1d1d2e-6c1b-5c51-9a52-7a8f0c6d5e11")
KEY = run_key(b"test key of the queries", "run-1")
GAP, IDLE = 12 * 3600, 24 * 3600
DAY = 86400


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as canonical events; frames are event ids, which follow time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").try_cast("int")
    t = F.col("event_type")
    protocol = F.when(t == "view", "NAS").when(t == "click", "NGAP").when(t == "purchase", "PFCP").otherwise("HTTP2")
    status = F.when(t == "error", F.when(k % 2 == 0, 400 + k).otherwise(500 + k)).otherwise(200)
    return e.select(
        "event_id",
        F.col("event_id").alias("frame"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("time"),
        F.col("user_id").alias("subject"),
        t.alias("message_type"),
        protocol.alias("protocol"),
        k.alias("k"),
        status.cast("int").alias("status"),
        F.when(t == "error", "failure").when(t == "purchase", "success").otherwise("request").alias("outcome"),
    )


EV = """ev AS (
    SELECT event_id, event_id AS frame, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS time, user_id AS subject, event_type AS message_type,
        CASE event_type WHEN 'view' THEN 'NAS' WHEN 'click' THEN 'NGAP' WHEN 'purchase' THEN 'PFCP' ELSE 'HTTP2' END AS protocol,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
        CAST(CASE WHEN event_type = 'error' THEN
            CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 2 = 0 THEN 400 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)
                 ELSE 500 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) END ELSE 200 END AS INTEGER) AS status,
        CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'request' END AS outcome
    FROM events)"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {EV} SELECT event_id, frame, CAST(us AS DECIMAL(28,0)) / 1000000 AS seconds_raw, subject, message_type, protocol, status, outcome,
    CASE WHEN status BETWEEN 200 AND 399 THEN 'success' WHEN status BETWEEN 400 AND 599 THEN 'failure' ELSE 'unknown' END AS status_class,
    CASE WHEN protocol IN ('NAS','NGAP','PFCP') THEN 'primary' WHEN message_type = 'error' THEN 'udr' WHEN message_type = 'signup' THEN 'nrf' ELSE 'primary' END AS part
    FROM ev""".replace("CAST(us AS DECIMAL(28,0)) / 1000000 AS seconds_raw", "us"))
def canonical_events(spark, d):
    e = canonical(spark, d)
    part = partition_of(F.col("protocol"), F.col("message_type"), {"nrf": ["signup"], "udr": ["error"]})
    return e.select("event_id", "frame", "us", "subject", "message_type", "protocol", "status", "outcome", status_class(F.col("status"), F.lit(False)).alias("status_class"), part.alias("part"))


@query(f"""WITH h AS (SELECT event_id, sha1(unhex('{SPACE.hex}') || encode(user_id || chr(31) || event_id)) AS h FROM events)
    SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def uuid5_ids(spark, d):
    return canonical(spark, d).select("event_id", uuid5(SPACE, F.col("subject"), F.col("event_id")).alias("uuid"))


_PADS = [bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"""SELECT user_id AS subject, count(*) AS n, 'supi:mask_' || substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode('supi:' || user_id)))), 1, 24) AS masked
    FROM events GROUP BY user_id""")
def mask_subject(spark, d):
    return canonical(spark, d).groupBy("subject").agg(F.count("*").alias("n")).select("subject", "n", mask(F.lit("supi"), F.col("subject").cast("string"), KEY).alias("masked"))


@query(f"""WITH {EV} SELECT event_id, subject FROM ev
    WHERE (protocol = 'NAS' AND k >= 0 AND message_type IN ('view')) OR (outcome = 'failure' AND status = 402)
       OR (message_type = 'click' AND k = 7)""")
def matcher_filter(spark, d):
    m = [
        EventMatcher(protocol="NAS", message_types=("view",), identifier_present=("k",)),
        EventMatcher(outcomes=("failure",), attribute_equals={"status": 402}),
        EventMatcher(message_types=("click",), attribute_equals={"k": 7}),
    ]
    return canonical(spark, d).filter(any_matcher(m)).select("event_id", "subject")


@query(f"""WITH {EV} SELECT event_id, ((k > 50) IS NOT NULL AND message_type = 'error') OR NOT (nullif(k, 0) = 3) AS verdict,
    (message_type = 'view' AND CAST(NULL AS BOOLEAN)) AS unknown_verdict FROM ev""")
def kleene_condition(spark, d):
    facts = {"type": F.col("message_type"), "k": F.nullif(F.col("k"), F.lit(0)), "any_k": F.col("k")}
    c = {"op": "or", "children": [{"op": "and", "children": [{"op": "present", "fact": "any_k"}, {"op": "eq", "fact": "type", "value": "error"}]}, {"op": "not", "children": [{"op": "eq", "fact": "k", "value": 3}]}]}
    u = {"op": "and", "children": [{"op": "eq", "fact": "type", "value": "view"}, {"op": "eq", "fact": "no such fact", "value": 1}]}
    return canonical(spark, d).select("event_id", condition(c, facts).alias("verdict"), condition(u, facts).alias("unknown_verdict"))


@query("""SELECT p_partkey, list_has_all(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''),
    list_filter(string_split(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS fits,
    p_name ILIKE '%' || p_brand || '%' AS named FROM part""")
def semantic_token_match(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", holds_tokens(F.col("p_type"), F.col("p_name")).alias("fits"), F.contains(F.lower("p_name"), F.lower("p_brand")).alias("named"))


@query(f"""WITH {EV} SELECT protocol, message_type, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT subject) AS n_subjects,
    count(*) FILTER (outcome = 'failure') AS n_failed FROM ev GROUP BY ROLLUP (protocol, message_type)""")
def index_counts(spark, d):
    return canonical(spark, d).rollup("protocol", "message_type").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count_distinct("subject").alias("n_subjects"), F.count_if(F.col("outcome") == "failure").alias("n_failed"))


@query(f"""WITH {EV} SELECT event_id, subject, status FROM ev WHERE frame BETWEEN 100 AND 4000 AND protocol IN ('HTTP2', 'PFCP') AND message_type = 'error'""")
def event_selectors(spark, d):
    e = select_events(canonical(spark, d), (100, 4000), ["HTTP2", "PFCP"], {"message_type": "error"})
    return authorised(e, F.col("frame") <= 4000).select("event_id", "subject", "status")


_TX = f"""WITH {EV}, x AS (SELECT subject, us // 86400000000 AS tx, * EXCLUDE (subject) FROM ev), tx AS (
    SELECT subject, tx AS transaction_key, count(*) AS n_events, min(frame) AS first_frame, max(frame) AS last_frame,
        arg_max(status, event_id) AS status, arg_min(protocol, event_id) FILTER (message_type <> 'error') AS method, arg_min(message_type, event_id) AS path,
        CASE WHEN bool_or(message_type = 'error' AND k > 90) THEN 'reset' WHEN bool_or(message_type = 'error' AND k < 5) THEN 'truncated'
             WHEN arg_min(protocol, event_id) FILTER (message_type <> 'error') IS NOT NULL THEN 'complete' ELSE min(outcome) END AS completion
    FROM x GROUP BY subject, tx)"""


def _transactions(spark, d):
    e = canonical(spark, d).withColumn("method", F.when(F.col("message_type") != "error", F.col("protocol"))).withColumn("path", F.col("message_type"))
    e = e.withColumn("reset", (F.col("message_type") == "error") & (F.col("k") > 90)).withColumn("truncated", (F.col("message_type") == "error") & (F.col("k") < 5)).withColumn("state", F.col("outcome"))
    return transactions(e, ["subject"], F.floor(F.col("us") / 86_400_000_000))


@query(_TX + " SELECT * FROM tx")
def transaction_groups(spark, d):
    return _transactions(spark, d)


@query(_TX + """, r AS (SELECT *, row_number() OVER (PARTITION BY subject, path ORDER BY transaction_key DESC) = 1 AS is_last, completion <> 'complete' AS bad FROM tx)
    SELECT subject, path, count(*) AS n_transactions, count(*) FILTER (bad AND NOT is_last) AS failed_before_last, min(first_frame) AS first_frame, max(last_frame) AS last_frame
    FROM r GROUP BY subject, path HAVING count(*) >= 2 AND count(*) FILTER (bad AND NOT is_last) >= 1""")
def retry_group_detection(spark, d):
    return retry_groups(_transactions(spark, d), ["subject", "path"], F.col("completion") != "complete", ["transaction_key"])


_MESSAGE = {"error": ("REGISTRATION_REJECT", "PAGING_FAILURE", "SESSION_ERROR"), "purchase": ("REGISTRATION_ACCEPT", "SESSION_COMPLETE", "CONTEXT_RELEASE"), "click": ("SERVICE_REQUEST", "SERVICE_ACCEPT", "PATH_SWITCH"), "view": ("IDENTITY_RESPONSE", "SECURITY_MODE_COMPLETE", "STATUS")}
# The causes of the query's messages.
_CAUSES = (None, "", "none", "normal", "0", "not_reachable", "protocol_error_17", "111")
_SQL_MESSAGE = " ".join(f"WHEN message_type = '{t}' AND k % 3 = {i} THEN '{m}'" for t, ms in _MESSAGE.items() for i, m in enumerate(ms))
_SQL_CAUSE = " ".join(f"WHEN k % 8 = {i} THEN " + ("NULL" if c is None else f"'{c}'") for i, c in enumerate(_CAUSES))


@query(f"""WITH {EV}, m AS (SELECT event_id, outcome, lower(coalesce(CASE {_SQL_MESSAGE} END, '')) AS m, lower(coalesce(CASE {_SQL_CAUSE} END, '')) AS c FROM ev)
    SELECT event_id, CASE WHEN regexp_matches(m, 'reject|fail|unsuccessful|error|not_reachable|unreachable|denied|invalid|missing') THEN 'failure'
        WHEN outcome = 'success' OR m LIKE '%accept%' OR m LIKE '%complete%' THEN 'success' WHEN c IN ('normal', 'normal_release', 'request_accepted', 'success', 'successful', '0', '1') THEN 'success'
        WHEN c NOT IN ('', 'none') OR outcome = 'failure' THEN 'failure' ELSE 'unknown' END AS class,
        regexp_matches(m || ' ' || c, 'paging|not_reachable|unreachable|mobile_terminated|mt_delivery') AS reachability FROM m""")
def cause_classes(spark, d):
    """Messages with names and causes made from the events: classes, and whether they speak of an unreachable subscriber."""
    e = canonical(spark, d)
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (k + 1).cast("int"))
    message = None
    for t, names in _MESSAGE.items():
        here = (F.col("message_type") == t, pick(names, F.col("k") % 3))
        message = F.when(*here) if message is None else message.when(*here)
    e = e.withColumn("m", message).withColumn("c", pick(_CAUSES, F.col("k") % 8))
    return e.select("event_id", cause_class(F.col("m"), F.col("outcome"), F.col("c")).alias("class"), speaks_of_reachability(F.coalesce("m", F.lit("")), F.coalesce("c", F.lit(""))).alias("reachability"))


_AT = f"""WITH {EV}, s AS (SELECT *, CASE WHEN lag(time) OVER w IS NULL OR time - lag(time) OVER w > {GAP} OR lag(message_type) OVER w IN ('purchase', 'error') THEN 1 ELSE 0 END AS st
        FROM ev WINDOW w AS (PARTITION BY subject ORDER BY frame)),
    lab AS (SELECT *, sum(st) OVER (PARTITION BY subject ORDER BY frame ROWS UNBOUNDED PRECEDING) AS attempt_no FROM s),
    att AS (SELECT subject, attempt_no, min(frame) AS start_frame, max(frame) AS end_frame, min(time) AS start_time, max(time) AS end_time, count(*) AS n_events,
        CASE WHEN bool_or(message_type = 'purchase') THEN 'succeeded' WHEN bool_or(message_type = 'error') THEN 'failed'
             WHEN (SELECT max(time) FROM ev) - max(time) > {GAP} THEN 'timed_out' ELSE 'incomplete_capture' END AS outcome
        FROM lab GROUP BY subject, attempt_no)"""


def _labelled(spark, d):
    e = canonical(spark, d)
    return A.islands(e, ["subject"], "frame", "time", GAP, F.col("message_type").isin("purchase", "error"))


def _attempts(spark, d):
    return _summarised(_labelled(spark, d), canonical(spark, d))


def _summarised(labelled, events):
    end = events.agg(F.max("time")).scalar()
    return A.summarise(labelled, ["subject"], F.col("message_type") == "purchase", F.col("message_type") == "error", "time", end, GAP)


def _kept(spark, d, what):
    """Labelled events and attempts, each written once, as the query uses them more than once."""
    folder = RunFolder(spark, what)
    lab = folder.write(_labelled(spark, d), "labelled")
    return lab, folder.write(_summarised(lab, lab), "attempts"), folder


@query(_AT + " SELECT * FROM att")
def attempt_segments(spark, d):
    return _attempts(spark, d)


PROFILES = [
    A.Profile("buy", ("view", "signup"), ("purchase",), ("error",), GAP, ("click",)),
    A.Profile("browse", ("click",), ("view",), ("error",), IDLE),
]


def _machine(p: A.Profile) -> str:
    """SQL of one profile's state machine, event by event: o is whether an attempt is open, x what has just expired, y what has just ended."""
    has = lambda kinds: "m IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"
    mine = has({*p.triggers, *p.success, *p.failure, *p.stages})
    gone = f"(o AND time - t1 > {p.timeout})"
    opens = f"((NOT o OR {gone}) AND {has(p.triggers)})"
    live = f"((o AND NOT {gone}) OR {opens})"
    ended = f"({live} AND {mine} AND ({has(p.success)} OR {has(p.failure)}))"
    step = f"CASE WHEN {opens} THEN {{0}} ELSE {{1}} END"
    last = f"CASE WHEN {live} AND {mine} OR {opens} THEN {{0}} ELSE {{1}} END"
    row = f"struct_pack(f0 := {step.format('frame', 'f0')}, f1 := {last.format('frame', 'f1')}, t0 := {step.format('time', 't0')}, t1 := {last.format('time', 't1')}, n := {step.format('0', 'n')} + CASE WHEN {live} AND {mine} THEN 1 ELSE 0 END)"
    return f"""(WITH RECURSIVE s AS (SELECT subject, 0::BIGINT AS i, false AS o, 0::BIGINT AS f0, 0::BIGINT AS f1, 0::BIGINT AS t0, 0::BIGINT AS t1, 0 AS n, NULL::STRUCT(f0 BIGINT, f1 BIGINT, t0 BIGINT, t1 BIGINT, n INTEGER) AS x, NULL::STRUCT(f0 BIGINT, f1 BIGINT, t0 BIGINT, t1 BIGINT, n INTEGER) AS y, '' AS how
            FROM (SELECT DISTINCT subject FROM e)
        UNION ALL SELECT subject, i, {live} AND NOT {ended}, r.f0, r.f1, r.t0, r.t1, r.n, CASE WHEN {gone} THEN struct_pack(f0 := f0, f1 := f1, t0 := t0, t1 := t1, n := n) END, CASE WHEN {ended} THEN r END, CASE WHEN {has(p.success)} THEN 'succeeded' ELSE 'failed' END
            FROM (SELECT q.*, {row} AS r FROM (SELECT s.subject, e.i, s.o, s.f0, s.f1, s.t0, s.t1, s.n, e.frame, e.time, e.m FROM s JOIN e ON e.subject = s.subject AND e.i = s.i + 1) q)),
        c AS (SELECT subject, x AS z, 'timed_out' AS outcome, 'response_timeout' AS reason FROM s WHERE x IS NOT NULL UNION ALL SELECT subject, y, how, CASE how WHEN 'succeeded' THEN 'success_terminal' ELSE 'failure_terminal' END FROM s WHERE y IS NOT NULL
            UNION ALL SELECT subject, struct_pack(f0 := f0, f1 := f1, t0 := t0, t1 := t1, n := n), CASE WHEN late THEN 'timed_out' ELSE 'incomplete_capture' END, CASE WHEN late THEN 'response_timeout' ELSE 'capture_ended_before_terminal' END
            FROM (SELECT s.*, (SELECT max(time) FROM e) - t1 > {p.timeout} AS late FROM s WHERE o AND i = (SELECT max(i) FROM e WHERE e.subject = s.subject)))
        SELECT CAST(subject AS VARCHAR) AS subject, '{p.profile_id}' AS profile_id, z.f0 AS start_frame, z.f1 AS end_frame, z.t0 AS start_time, z.t1 AS end_time, z.n AS n_events, outcome, reason FROM c)"""


@query(f"WITH {EV}, e AS (SELECT subject, frame, time, message_type AS m, row_number() OVER (PARTITION BY subject ORDER BY frame, message_type) AS i FROM ev) " + " UNION ALL ".join(f"SELECT * FROM {_machine(p)}" for p in PROFILES))
def attempts_general(spark, d):
    """Two profiles at once."""
    e = canonical(spark, d)
    end = e.agg(F.max("time")).first()[0] or 0
    return A.segment_attempts(e, PROFILES, end)


@query(_AT + f""" SELECT subject, attempt_no, outcome, row_number() OVER w AS sequence_no,
    CASE WHEN lag(outcome) OVER w IN ('failed', 'timed_out') AND start_time - lag(end_time) OVER w <= {DAY} THEN lag(attempt_no) OVER w END AS retry_of
    FROM att WINDOW w AS (PARTITION BY subject ORDER BY end_frame)""")
def sequence_and_retries(spark, d):
    return A.link_retries(_attempts(spark, d), ["subject"], "end_frame", "start_time", "end_time", DAY).select("subject", "attempt_no", "outcome", "sequence_no", "retry_of")


@query(_AT + """ , fa AS (SELECT subject, attempt_no, start_frame FROM att WHERE outcome = 'failed'), su AS (SELECT subject, end_frame, attempt_no FROM att WHERE outcome = 'succeeded')
    SELECT fa.subject, fa.attempt_no, fa.start_frame, su.attempt_no AS as_of_attempt_no FROM fa ASOF LEFT JOIN su ON fa.subject = su.subject AND fa.start_frame >= su.end_frame""")
def asof_prior_success(spark, d):
    _, a, _ = _kept(spark, d, "asof")
    failed = a.filter("outcome = 'failed'").select("subject", "attempt_no", "start_frame")
    return J.last_before(failed, a.filter("outcome = 'succeeded'"), ["subject"], "start_frame", "end_frame", ["attempt_no"])


STAGES = ["view", "click", "purchase"]
_ST = _AT + """, seen AS (SELECT subject, attempt_no, message_type AS stage, min(frame) AS first_frame FROM lab WHERE message_type IN ('view', 'click', 'purchase') GROUP BY ALL),
    grid AS (SELECT a.subject, a.attempt_no, a.outcome, v.stage_no, v.stage FROM att a, (VALUES (0, 'view'), (1, 'click'), (2, 'purchase')) v(stage_no, stage)),
    st AS (SELECT g.subject, g.attempt_no, g.stage_no, g.stage, s.first_frame, CASE WHEN s.first_frame IS NOT NULL THEN 'completed'
        WHEN coalesce(bool_or(s.first_frame IS NULL) OVER (PARTITION BY g.subject, g.attempt_no ORDER BY g.stage_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'skipped' ELSE 'missing' END AS state
        FROM grid g LEFT JOIN seen s USING (subject, attempt_no, stage))"""


def _stages(labelled):
    seen = labelled.withColumn("stage", F.col("message_type"))
    return R.stage_states(seen.select("subject", "attempt_no").distinct(), seen, STAGES, ["subject", "attempt_no"])


@query(_ST + " SELECT subject, attempt_no, stage_no, stage, first_frame, state FROM st")
def missing_stages(spark, d):
    lab = RunFolder(spark, "stages").write(_labelled(spark, d), "labelled")
    return _stages(lab).select("subject", "attempt_no", "stage_no", "stage", "first_frame", "state")


@query(_ST + """ SELECT subject, attempt_no, stage FROM st WHERE state = 'missing'
    AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.subject = st.subject AND lab.attempt_no = st.attempt_no AND lab.message_type = 'error')""")
def unexplained_missing(spark, d):
    lab = RunFolder(spark, "stages").write(_labelled(spark, d), "labelled")
    explained = lab.filter("message_type = 'error'").select("subject", "attempt_no")
    return _stages(lab).filter("state = 'missing'").join(explained, ["subject", "attempt_no"], "left_anti").select("subject", "attempt_no", "stage")


@query(f"""WITH {EV}, i AS (SELECT subject, frame, 'event' AS item, message_type AS label FROM ev UNION ALL
    SELECT subject, frame, 'candidate', CASE WHEN status >= 500 THEN 'critical' ELSE 'error' END FROM ev WHERE status >= 400),
    o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY frame, item) - 1 AS ordinal FROM i) SELECT subject, frame, item, label, ordinal FROM o WHERE ordinal < 50""")
def timeline_topk(spark, d):
    e = canonical(spark, d)
    events = e.select("subject", "frame", F.lit("event").alias("item"), F.col("message_type").alias("label"))
    found = e.filter("status >= 400").select("subject", "frame", F.lit("candidate").alias("item"), F.when(F.col("status") >= 500, "critical").otherwise("error").alias("label"))
    return R.timeline([events, found], ["subject"], ["frame", "item"], 50)


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT subject, frame, octet_length(encode('{{"event_id":' || event_id || ',"message_type":"' || message_type || '","status":' || status || '}}')) AS size,
        row_number() OVER (PARTITION BY subject ORDER BY frame) AS i FROM ev WHERE outcome = 'failure'),
    p AS (SELECT subject, frame, size, i, 0 AS page, size AS used, 1 AS n FROM r WHERE i = 1 UNION ALL
        SELECT r.subject, r.frame, r.size, r.i, CASE WHEN used + r.size > 600 OR n >= 12 THEN page + 1 ELSE page END, CASE WHEN used + r.size > 600 OR n >= 12 THEN r.size ELSE used + r.size END,
            CASE WHEN used + r.size > 600 OR n >= 12 THEN 1 ELSE n + 1 END FROM p JOIN r ON r.subject = p.subject AND r.i = p.i + 1)
    SELECT subject, frame, size, page FROM p""")
def paginate_bytes(spark, d):
    """Pages of each subject's failures."""
    e = canonical(spark, d).filter("outcome = 'failure'")
    return R.pages(e, ["subject"], ["frame"], F.octet_length(F.to_json(F.struct("event_id", "message_type", "status"))), 600, 12)


_CAND = f"""{_AT}, c AS (SELECT l.subject, l.attempt_no, l.event_id, l.frame, CASE l.protocol WHEN 'NAS' THEN 0 WHEN 'NGAP' THEN 1 WHEN 'HTTP2' THEN 2 ELSE 3 END AS pr,
    CAST(least(greatest(CAST(0.7 AS DECIMAL(12,6)) + CASE WHEN l.status >= 500 THEN 0.1 ELSE 0 END + CASE WHEN l.message_type = 'error' THEN 0.08 ELSE 0 END
        + CASE WHEN l.frame = a.end_frame THEN 0.08 ELSE 0 END - CASE WHEN a.outcome = 'incomplete_capture' THEN 0.15 ELSE 0 END - CAST(coalesce(l.k, 0) AS DECIMAL(12,6)) / 200, 0), 1) AS DECIMAL(12,6)) AS raw
    FROM lab l JOIN att a USING (subject, attempt_no) WHERE l.outcome <> 'success')"""


def _candidates(spark, d):
    lab, a, _ = _kept(spark, d, "rank")
    c = lab.filter("outcome != 'success'").select("subject", "attempt_no", "event_id", "frame", "protocol", "status", "message_type", "k").join(a.select("subject", "attempt_no", "end_frame", F.col("outcome").alias("ended")), ["subject", "attempt_no"])
    terms = [
        F.lit("0.7"),
        F.when(F.col("status") >= 500, "0.1"),
        F.when(F.col("message_type") == "error", "0.08"),
        F.when(F.col("frame") == F.col("end_frame"), "0.08"),
        F.when(F.col("ended") == "incomplete_capture", "-0.15"),
        -(F.coalesce("k", F.lit(0)).cast("decimal(12,6)") / 200),
    ]
    pr = F.when(F.col("protocol") == "NAS", 0).when(F.col("protocol") == "NGAP", 1).when(F.col("protocol") == "HTTP2", 2).otherwise(3)
    return c.withColumn("score", R.clamped_sum(terms)).withColumn("pr", pr)


@query(_CAND + """, sc AS (SELECT *, CAST(round_even(raw, 4) AS DECIMAL(10,4)) AS score FROM c), kept AS (SELECT * FROM sc WHERE score >= 0.45),
    r AS (SELECT *, row_number() OVER w AS candidate_rank, first_value(score) OVER w AS top FROM kept WINDOW w AS (PARTITION BY subject, attempt_no ORDER BY score DESC, frame, pr, event_id))
    SELECT subject, attempt_no, event_id, CAST(score AS DOUBLE) AS score, candidate_rank,
        CASE WHEN candidate_rank = 1 THEN 'primary' WHEN top - score <= 0.15 THEN 'alternative' ELSE 'downstream' END AS classification FROM r""")
def rank_root_causes(spark, d):
    r = R.rank(_candidates(spark, d), ["subject", "attempt_no"], "score", [F.col("frame"), F.col("pr"), F.col("event_id")], 0.45, 0.15)
    return r.select("subject", "attempt_no", "event_id", F.col("score").cast("double").alias("score"), "candidate_rank", "classification")


@query(_ST + """, best AS (SELECT subject, min(attempt_no) AS base FROM att WHERE outcome = 'succeeded' GROUP BY subject), f AS (SELECT subject, attempt_no FROM att WHERE outcome = 'failed'),
    l AS (SELECT f.subject, f.attempt_no, st.stage, st.state FROM f JOIN best USING (subject) JOIN st ON st.subject = f.subject AND st.attempt_no = best.base WHERE st.state = 'completed'),
    r AS (SELECT f.subject, f.attempt_no, st.stage, st.state FROM f JOIN best USING (subject) JOIN st ON st.subject = f.subject AND st.attempt_no = f.attempt_no WHERE st.state = 'completed')
    SELECT subject, attempt_no, stage, l.state AS left_value, r.state AS right_value, CASE WHEN r.state IS NULL THEN 'missing' WHEN l.state IS NULL THEN 'extra' ELSE 'matched' END AS relation
    FROM l FULL OUTER JOIN r USING (subject, attempt_no, stage)""")
def stage_alignment(spark, d):
    st, failed, best = _alignment(spark, d)
    left = failed.join(best, "subject").join(st.withColumnRenamed("attempt_no", "base"), ["subject", "base"])
    right = failed.join(best.select("subject"), "subject", "left_semi").join(st, ["subject", "attempt_no"])
    return J.compare(left, right, ["subject", "attempt_no", "stage"], "state")


def _alignment(spark, d):
    lab, a, folder = _kept(spark, d, "align")
    st = folder.write(_stages(lab), "stages").filter("state = 'completed'").select("subject", "attempt_no", "stage", "state")
    return st, a.filter("outcome = 'failed'").select("subject", "attempt_no"), a.filter("outcome = 'succeeded'").groupBy("subject").agg(F.min("attempt_no").alias("base"))


@query()
def first_divergences(spark, d):
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")).alias("stage_no")
    return R.first_divergence(stage_alignment(spark, d).select("*", place), ["subject", "attempt_no"], ["stage_no", "stage"])


SQL["first_divergences"] = f"""WITH al AS ({SQL['stage_alignment']}), n AS (SELECT *, CAST(CASE stage WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS BIGINT) AS stage_no FROM al WHERE relation <> 'matched'),
    o AS (SELECT *, row_number() OVER (PARTITION BY subject, attempt_no ORDER BY stage_no) AS q FROM n) SELECT subject, attempt_no, stage_no, stage, relation FROM o WHERE q = 1"""


@query(_AT + """, fa AS (SELECT subject, attempt_no, n_events, start_frame FROM att WHERE outcome = 'failed'), su AS (SELECT subject, attempt_no AS base, n_events AS base_events, end_frame FROM att WHERE outcome = 'succeeded'),
    p AS (SELECT fa.subject, fa.attempt_no, su.base, fa.start_frame - su.end_frame AS distance, (CASE WHEN fa.n_events = su.base_events THEN 1 ELSE 0 END) / 1.0 AS similarity
          FROM fa JOIN su ON fa.subject = su.subject AND su.end_frame < fa.start_frame),
    o AS (SELECT *, row_number() OVER (PARTITION BY subject, attempt_no ORDER BY similarity DESC, distance, base) AS place FROM p) SELECT subject, attempt_no, base, distance, CAST(similarity AS DOUBLE) AS similarity, place FROM o WHERE place <= 2""")
def baseline_topk(spark, d):
    """The two best earlier successes of each failed attempt: with as many events, then nearest.

    Each success also names the one before it, of all and of those with as many
    events, so two as-of joins give all that can be among the best two.
    """
    _, a, _ = _kept(spark, d, "base")
    f = a.filter("outcome = 'failed'").select("subject", "n_events", "attempt_no", "start_frame", (F.col("start_frame") - 1).alias("at"))
    s = a.filter("outcome = 'succeeded'").select("subject", "n_events", "end_frame", F.struct(F.col("attempt_no").alias("base"), "end_frame", "n_events").alias("b"))
    block = F.floor(F.col("end_frame") / A.BLOCK)
    near = J.last_before(f, with_neighbour(s, ["subject"], block, ["end_frame"], F.col("b"), "p"), ["subject"], "at", "end_frame", ["b", "p"]).withColumnsRenamed({"as_of_b": "b1", "as_of_p": "b2"})
    both = J.last_before(near, with_neighbour(s, ["subject", "n_events"], block, ["end_frame"], F.col("b"), "p"), ["subject", "n_events"], "at", "end_frame", ["b", "p"])
    found = F.array_distinct(F.array_compact(F.array("b1", "b2", "as_of_b", "as_of_p")))
    c = both.select("subject", "attempt_no", "n_events", "start_frame", F.explode(found).alias("b"))
    scored = c.select("subject", "attempt_no", F.col("b.base").alias("base"), (F.col("start_frame") - F.col("b.end_frame")).alias("distance"), (F.col("n_events") == F.col("b.n_events")).cast("double").alias("similarity"))
    return R.timeline([scored], ["subject", "attempt_no"], [F.col("similarity").desc(), F.col("distance"), F.col("base")], 2).withColumn("place", F.col("ordinal") + 1).drop("ordinal")


@query("""WITH l AS (SELECT subject, attempt_no, 'outcome' AS field, outcome AS v FROM att UNION ALL SELECT subject, attempt_no, 'n_events', CAST(n_events AS VARCHAR) FROM att),
    p AS (SELECT a.subject, a.attempt_no, a.v AS x, b.v AS y FROM l a JOIN l b ON a.subject = b.subject AND a.field = b.field AND b.attempt_no = a.attempt_no - 1)
    SELECT subject, attempt_no, count(*) FILTER (x = y) / CAST(count(*) AS DOUBLE) AS similarity FROM p GROUP BY subject, attempt_no""".replace("WITH l AS", _AT + ", l AS", 1))
def request_similarity(spark, d):
    """How alike each attempt is to the one before it."""
    _, a, _ = _kept(spark, d, "similar")
    a = a.select("subject", "attempt_no", "outcome", F.col("n_events").cast("string").alias("n_events"))
    l = a.unpivot(["subject", "attempt_no"], ["outcome", "n_events"], "field", "left_value")
    r = l.select("subject", (F.col("attempt_no") + 1).alias("attempt_no"), "field", F.col("left_value").alias("right_value"))
    return J.similarity(l.join(r, ["subject", "attempt_no", "field"]), ["subject", "attempt_no"], "left_value", "right_value")


@query(_AT + """, m AS (SELECT min(frame) AS f, max(frame) AS l FROM ev), sp AS (SELECT greatest(start_frame - 20, m.f) AS a, least(end_frame + 20, m.l) AS b FROM att, m),
    e AS (SELECT frame, sum(d) AS d FROM (SELECT a AS frame, 1 AS d FROM sp UNION ALL SELECT b + 1, -1 FROM sp UNION ALL SELECT f, 0 FROM m) GROUP BY frame),
    p AS (SELECT frame AS from_frame, coalesce(lead(frame) OVER (ORDER BY frame), (SELECT l FROM m) + 1) - 1 AS to_frame, sum(d) OVER (ORDER BY frame) AS n_active FROM e)
    SELECT from_frame, to_frame, CAST(n_active AS BIGINT) AS n_active, CASE WHEN n_active > 0 THEN 'attempt_active' WHEN to_frame < (SELECT min(a) FROM sp) THEN 'capture_preamble'
        WHEN from_frame > (SELECT max(b) FROM sp) THEN 'capture_postamble' ELSE 'between_attempts' END AS phase FROM p WHERE from_frame <= (SELECT l FROM m)""")
def phase_sweep(spark, d):
    return _phases(spark, d)


def _phases(spark, d):
    lab, a, folder = _kept(spark, d, "sweep")
    lo, hi = (F.coalesce(lab.agg(f("frame")).scalar(), F.lit(0)) for f in (F.min, F.max))
    return folder.write(sweep(a, "start_frame", "end_frame", 20, lo, hi), "phases")


@query(f"WITH ph AS ({SQL['phase_sweep']}), e AS (SELECT event_id, event_id AS frame FROM events) SELECT event_id, phase, n_active FROM e JOIN ph ON frame BETWEEN from_frame AND to_frame")
def event_phases(spark, d):
    e = canonical(spark, d).select("event_id", "frame", F.lit(1).alias("one"))
    return J.in_interval(e, _phases(spark, d).withColumn("one", F.lit(1)), ["one"], "frame", "from_frame", "to_frame", 256).select("event_id", "phase", "n_active")


@query(f"""WITH {EV}, i AS (SELECT status AS code, event_id, row_number() OVER (PARTITION BY status ORDER BY frame) AS sample_no FROM ev WHERE status >= 400) SELECT code, event_id, sample_no FROM i WHERE sample_no <= 5""")
def issue_sampling(spark, d):
    i = canonical(spark, d).filter("status >= 400").select(F.col("status").alias("code"), "event_id", "frame")
    return first_per_code(i, "code", ["frame"], 5).select("code", "event_id", "sample_no")


@query(f"""WITH {EV} SELECT subject, CASE WHEN bool_or(status >= 595) THEN 'failed' WHEN bool_or(status >= 500) THEN 'partial' WHEN count(*) = 0 THEN 'empty' ELSE 'success' END AS state FROM ev GROUP BY subject""")
def status_folding(spark, d):
    flags = {"failed": F.bool_or(F.col("status") >= 595), "partial": F.bool_or(F.col("status") >= 500), "empty": F.count("*") == 0}
    return canonical(spark, d).groupBy("subject").agg(state_of(flags).alias("state"))


@query(f"""WITH {EV}, a AS (SELECT event_id AS anchor_id, frame AS anchor_frame FROM ev WHERE status >= 598)
    SELECT anchor_id, e.event_id, e.frame - anchor_frame AS frame_offset FROM a JOIN ev e ON e.frame BETWEEN anchor_frame - 10 AND anchor_frame + 5""")
def context_window(spark, d):
    e = canonical(spark, d)
    anchors = e.filter("status >= 598").select(F.col("event_id").alias("anchor_id"), F.col("frame").alias("anchor_frame"))
    return J.around(anchors, e.select("event_id", "frame"), "anchor_frame", "frame", 10, 5).select("anchor_id", "event_id", (F.col("frame") - F.col("anchor_frame")).alias("frame_offset"))


@query(f"""WITH {EV}, f AS (SELECT subject, min(frame) FILTER (message_type = 'signup') AS a, min(frame) FILTER (message_type = 'purchase') AS b FROM ev GROUP BY subject)
    SELECT f.subject, a < b AS before, (SELECT count(*) FROM ev WHERE ev.subject = f.subject AND frame > a AND frame < b) AS n_between,
        (SELECT count(*) FROM ev WHERE ev.subject = f.subject AND frame > a AND frame < b AND message_type = 'error') = 0 AS none_forbidden FROM f""")
def ordering_constraints(spark, d):
    """Whether a checkpoint's first event comes before another's, with how many events between and none of a forbidden kind."""
    e = canonical(spark, d)
    f = e.groupBy("subject").agg(F.min(F.when(F.col("message_type") == "signup", F.col("frame"))).alias("a"), F.min(F.when(F.col("message_type") == "purchase", F.col("frame"))).alias("b"))
    inside = (F.col("frame") > F.col("a")) & (F.col("frame") < F.col("b"))
    g = e.select("subject", "frame", "message_type").join(f, "subject").groupBy("subject", "a", "b")
    c = g.agg(F.count_if(inside).alias("n_between"), F.count_if(inside & (F.col("message_type") == "error")).alias("bad"))
    return c.select("subject", (F.col("a") < F.col("b")).alias("before"), "n_between", (F.col("bad") == 0).alias("none_forbidden"))


@query(f"""WITH {EV}, t AS (SELECT event_id, message_type, CASE WHEN status >= 500 THEN 'failure' WHEN status >= 400 THEN 'degraded' ELSE 'serving' END AS state,
    row_number() OVER (PARTITION BY message_type ORDER BY frame) AS n, lag(CASE WHEN status >= 500 THEN 'failure' WHEN status >= 400 THEN 'degraded' ELSE 'serving' END) OVER (PARTITION BY subject ORDER BY frame) AS was, subject, frame FROM ev)
    SELECT subject, frame, was AS from_state, state AS to_state FROM t WHERE was IS NOT NULL AND was <> state""")
def lifecycle_transitions(spark, d):
    state = F.when(F.col("status") >= 500, "failure").when(F.col("status") >= 400, "degraded").otherwise("serving")
    e = canonical(spark, d).withColumn("to_state", state)
    e = with_neighbour(e, ["subject"], F.floor(F.col("frame") / A.BLOCK), ["frame"], F.col("to_state"), "from_state")
    return e.filter("from_state is not null and from_state != to_state").select("subject", "frame", "from_state", "to_state")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
    s AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 43200000000 THEN 0 ELSE 1 END AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM s)
    SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n_events FROM n GROUP BY user_id, no""")
def stream_sessions(spark, d):
    """All sessions of the stream, those open at its end too."""
    s = run_sessions(file_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "12 hours", RunFolder(spark, "sessions"))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n_events")


_IS = lambda *types, **more: EventMatcher(message_types=types, **more)
PROCEDURES = [
    P.Procedure("session", (_IS("signup"), _IS("view")), (P.Stage("click", 1, (_IS("click"),), repeatable=True), P.Stage("pay", 2, (_IS("purchase"),), "succeeded")), failure=(_IS("error"),), response_timeout=GAP),
    P.Procedure("lookup", (_IS("click", attribute_equals={"even": True}),), (P.Stage("seen", 1, (_IS("view"),)),), success=(_IS("purchase"),), failure=(EventMatcher(outcomes=("failure",)),), abort=(_IS("signup"),), response_timeout=IDLE, parents=("session",)),
]
SCORING = P.Scoring(idle_timeout=DAY)


def _procedures(spark, d):
    """Three subjects share a group; a subject changes its access context from day to day and has two sessions."""
    e = canonical(spark, d).withColumn("even", F.col("k") % 2 == 0)
    name = lambda *parts: F.concat_ws(":", *[x.cast("string") for x in parts])
    e = e.select(
        "*", F.floor(F.col("subject") / 3).alias("group"), F.col("frame").alias("seq"), F.col("subject").cast("string").alias("ue"), name(F.col("subject"), F.floor(F.col("time") / (3 * DAY))).alias("access"),
        name(F.col("subject"), F.col("k") % 2).alias("session"), F.when(F.col("k") < 50, F.col("k") % 4).alias("pdu"), F.lit(None).cast("string").alias("amf"), F.lit(None).cast("string").alias("ran"),
    )
    return P.assign(e, PROCEDURES, scoring=SCORING)


@query()
def procedure_attempts(spark, d):
    """Attempts of overlapping procedures by scored assignment; tested against a plain loop."""
    return _procedures(spark, d).attempts


@query()
def procedure_assignments(spark, d):
    """Every event with its attempt, or why it has none; tested against a plain loop."""
    return _procedures(spark, d).assignments


@query()
def procedure_links(spark, d):
    """Parents, transfers to another access context and superseded attempts; tested against a plain loop."""
    a = _procedures(spark, d).attempts
    parents = a.filter("parent_id is not null").select(F.col("parent_id").alias("left_attempt_id"), F.col("attempt_id").alias("right_attempt_id"), F.lit("parent_child").alias("relation"))
    moved = P.nearest_prior(a, ["session"], ["session", "lookup"], "access_transfer", other_access=True)
    return parents.unionByName(moved).unionByName(P.nearest_prior(a, ["session"], ["session"], "supersedes"))


RULES = [
    S.StageRule("view", 0),
    S.StageRule("click", 1, predecessors=("view",), timeout=3 * 3600),
    S.StageRule("purchase", 2, predecessors=("view", "click"), timeout=6 * 3600, terminal_success=True),
    S.StageRule("signup", 3, "optional"),
    S.StageRule("error", 4, "conditional", condition={"op": "eq", "fact": "outcome", "value": "failed"}, visible=("visible",)),
    S.StageRule("refund", 5, "conditional", ("view",), {"op": "and", "children": [{"op": "ne", "fact": "outcome", "value": "succeeded"}, {"op": "not", "children": [{"op": "eq", "fact": "attempt_no", "value": 1}]}]}),
    S.StageRule("audit", 6, "conditional", ("view",), {"op": "eq", "fact": "no such fact", "value": 1}),
]


@query(_AT + f""", sg AS (SELECT subject, attempt_no, message_type AS stage, min(frame) AS f, max(frame) AS l, max(time) AS t FROM lab GROUP BY ALL),
    a AS (SELECT subject, attempt_no, outcome, start_time, n_events < 3 AS hidden, start_frame = (SELECT min(frame) FROM ev) AS cut FROM att),
    w AS (SELECT a.*, v.f AS vf, v.l AS vl, v.t AS vt, c.f AS cf, c.l AS cl, c.t AS ct, p.f AS pf, p.l AS pl, p.t AS pt, u.f AS uf, u.l AS ul, e.f AS ef, e.l AS el FROM a
        LEFT JOIN sg v ON v.subject = a.subject AND v.attempt_no = a.attempt_no AND v.stage = 'view' LEFT JOIN sg c ON c.subject = a.subject AND c.attempt_no = a.attempt_no AND c.stage = 'click'
        LEFT JOIN sg p ON p.subject = a.subject AND p.attempt_no = a.attempt_no AND p.stage = 'purchase' LEFT JOIN sg u ON u.subject = a.subject AND u.attempt_no = a.attempt_no AND u.stage = 'signup'
        LEFT JOIN sg e ON e.subject = a.subject AND e.attempt_no = a.attempt_no AND e.stage = 'error'),
    r AS (SELECT subject, attempt_no, 'view' AS stage_id, 0 AS stage_no, CASE WHEN vf IS NOT NULL THEN 'completed/observed_stage' WHEN cut THEN 'skipped/history_incomplete' WHEN ef IS NOT NULL THEN 'suppressed/explicit_evidence' WHEN uf IS NOT NULL THEN 'suppressed/request_only' ELSE 'missing/required_stage' END AS s, vf AS first_frame, vl AS last_frame, NULL AS deadline FROM w
        UNION ALL SELECT subject, attempt_no, 'click', 1, CASE WHEN ct > vt + {3 * 3600} THEN 'completed/deadline_missed' WHEN cf IS NOT NULL THEN 'completed/observed_stage' WHEN vf IS NULL THEN 'skipped/predecessor_not_reached' WHEN cut THEN 'skipped/history_incomplete' WHEN ef IS NOT NULL THEN 'suppressed/explicit_evidence' ELSE 'missing/required_stage' END, cf, cl, vt + {3 * 3600} FROM w
        UNION ALL SELECT subject, attempt_no, 'purchase', 2, CASE WHEN pt > greatest(vt, ct) + {6 * 3600} THEN 'completed/deadline_missed' WHEN pf IS NOT NULL THEN 'completed/observed_stage' WHEN vf IS NULL OR cf IS NULL THEN 'skipped/predecessor_not_reached' WHEN cut THEN 'skipped/history_incomplete' ELSE 'missing/required_stage' END, pf, pl, greatest(vt, ct) + {6 * 3600} FROM w
        UNION ALL SELECT subject, attempt_no, 'signup', 3, CASE WHEN uf IS NOT NULL THEN 'completed/observed_stage' ELSE 'skipped/optional_stage' END, uf, ul, NULL FROM w
        UNION ALL SELECT subject, attempt_no, 'error', 4, CASE WHEN ef IS NOT NULL THEN 'completed/observed_stage' WHEN outcome <> 'failed' THEN 'skipped/condition_false' WHEN hidden THEN 'skipped/not_visible' WHEN cut THEN 'skipped/history_incomplete' ELSE 'missing/required_stage' END, ef, el, NULL FROM w
        UNION ALL SELECT subject, attempt_no, 'refund', 5, CASE WHEN outcome = 'succeeded' OR attempt_no = 1 THEN 'skipped/condition_false' WHEN vf IS NULL THEN 'skipped/predecessor_not_reached' WHEN cut THEN 'skipped/history_incomplete' ELSE 'missing/required_stage' END, NULL, NULL, NULL FROM w
        UNION ALL SELECT subject, attempt_no, 'audit', 6, 'skipped/fact_unknown', NULL, NULL, NULL FROM w)
    SELECT subject, attempt_no, stage_id, stage_no, split_part(s, '/', 1) AS state, split_part(s, '/', 2) AS reason, first_frame, last_frame, deadline FROM r""")
def stage_dag(spark, d):
    """What became of each stage of each attempt, by predecessors, conditions, deadlines and evidence."""
    lab, a, _ = _kept(spark, d, "dag")
    a = a.withColumn("visible", F.col("n_events") >= 3).withColumn("incomplete_history", F.col("start_frame") == lab.agg(F.min("frame")).scalar())
    seen = lab.select("subject", "attempt_no", F.col("message_type").alias("stage_id"), "frame", "time")
    pairs = lambda kind, stages: lab.filter(F.col("message_type") == kind).select("subject", "attempt_no", F.explode(F.array(*[F.lit(x) for x in stages])).alias("stage_id"))
    facts = {"outcome": F.col("outcome"), "attempt_no": F.col("attempt_no")}
    return S.stage_results(a, seen, RULES, ["subject", "attempt_no"], facts, pairs("error", ["view", "click"]), pairs("signup", ["view", "purchase"]))


DEMANDS = [S.Ordering("b", "before", "signup", "purchase"), S.Ordering("i", "immediately_before", "view", "click"), S.Ordering("n", "at_least_n_between", "signup", "purchase", n=2), S.Ordering("f", "no_forbidden_between", "signup", "purchase", forbidden=("error", "view"))]


@query(f"""WITH {EV}, o AS (SELECT subject, message_type AS c, frame FROM ev), f AS (SELECT subject, min(frame) FILTER (c = 'signup') AS s, min(frame) FILTER (c = 'purchase') AS p, min(frame) FILTER (c = 'view') AS v, min(frame) FILTER (c = 'click') AS k FROM o GROUP BY subject),
    x AS (SELECT subject, c, min(frame) AS m FROM o GROUP BY ALL)
    SELECT subject, 'b' AS name, s < p AS verdict FROM f UNION ALL SELECT subject, 'i', CASE WHEN v < k IS NOT NULL THEN v < k AND NOT EXISTS (SELECT 1 FROM x WHERE x.subject = f.subject AND m > v AND m < k) END FROM f
    UNION ALL SELECT subject, 'n', CASE WHEN s < p IS NOT NULL THEN s < p AND (SELECT count(*) FROM o WHERE o.subject = f.subject AND frame > s AND frame < p) >= 2 END FROM f
    UNION ALL SELECT subject, 'f', CASE WHEN s < p IS NOT NULL THEN s < p AND (SELECT count(*) FROM o WHERE o.subject = f.subject AND frame > s AND frame < p AND c IN ('error', 'view')) = 0 END FROM f""")
def ordering_forms(spark, d):
    """The four forms of demands on the order of checkpoints."""
    e = canonical(spark, d)
    return S.orderings(e.select("subject", F.col("message_type").alias("checkpoint"), "frame"), ["subject"], DEMANDS)


CHECKPOINTS = [
    S.Checkpoint("s1", "paid", protocol="PFCP", message="purchase", fields=(("k", "present", None),)),
    S.Checkpoint("s1", "no critical error", message="error", fields=(("status", "in", (501, 503, 505, 507)),), forbidden=True),
    S.Checkpoint("s2", "early click", protocol="NGAP", frames=(1, 2000), fields=(("k", "ne", 7), ("outcome", "eq", "request"))),
]


@query(f"""WITH {EV}, v AS (SELECT subject, bool_and(k > 0) AS seen, count(*) FILTER (protocol = 'PFCP' AND message_type = 'purchase' AND k IS NOT NULL) AS n0, min(frame) FILTER (protocol = 'PFCP' AND message_type = 'purchase' AND k IS NOT NULL) AS f0,
        count(*) FILTER (message_type = 'error' AND status IN (501, 503, 505, 507)) AS n1, min(frame) FILTER (message_type = 'error' AND status IN (501, 503, 505, 507)) AS f1, count(*) FILTER (protocol = 'NGAP' AND frame BETWEEN 1 AND 2000 AND k <> 7 AND outcome = 'request') AS n2,
        min(frame) FILTER (protocol = 'NGAP' AND frame BETWEEN 1 AND 2000 AND k <> 7 AND outcome = 'request') AS f2 FROM ev GROUP BY subject)
    SELECT subject, 's1' AS scenario, 'paid' AS name, n0 AS n_found, f0 AS first_frame, CASE WHEN n0 > 0 THEN 'passed' WHEN seen THEN 'failed' ELSE 'inconclusive' END AS verdict FROM v
    UNION ALL SELECT subject, 's1', 'no critical error', n1, f1, CASE WHEN n1 > 0 THEN 'failed' WHEN seen THEN 'passed' ELSE 'inconclusive' END FROM v UNION ALL SELECT subject, 's2', 'early click', n2, f2, CASE WHEN n2 > 0 THEN 'passed' WHEN seen THEN 'failed' ELSE 'inconclusive' END FROM v""")
def scenario_checkpoints(spark, d):
    """What each subject's events say about the checkpoints of two scenarios; absence counts only where all was visible."""
    return S.checkpoint_verdicts(canonical(spark, d), CHECKPOINTS, ["subject"], visible=F.col("k") > 0)


@query(f"""WITH c AS ({SQL['scenario_checkpoints']}) SELECT subject, scenario, CASE WHEN bool_or(verdict = 'failed') THEN 'failed' WHEN bool_or(verdict = 'inconclusive') THEN 'inconclusive' ELSE 'passed' END AS status,
    count(*) FILTER (verdict = 'failed') AS n_failed, count(*) AS n_checkpoints FROM c GROUP BY subject, scenario""")
def scenario_status(spark, d):
    return S.fold_verdicts(scenario_checkpoints(spark, d), ["subject"])


@query(f"""WITH {EV} SELECT event_id, subject, coalesce(bool_or(outcome = 'failure') OVER (PARTITION BY subject ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS downstream_possible FROM ev WHERE outcome = 'failure'""")
def downstream_failures(spark, d):
    """Each failure, and whether one of its subject came before it."""
    e = S.with_earlier(canonical(spark, d), ["subject"], "frame", F.col("outcome") == "failure", "downstream_possible")
    return e.filter("outcome = 'failure'").select("event_id", "subject", "downstream_possible")


@query(_AT + """ SELECT subject, outcome, count(*) AS n, min(attempt_no) AS first_attempt, max(attempt_no) AS last_attempt, min(start_frame) AS first_frame, max(end_frame) AS last_frame FROM att GROUP BY GROUPING SETS ((subject, outcome), (outcome), ())""")
def attempt_indexes(spark, d):
    """Attempts by subject and outcome, by outcome, and of all."""
    a = _attempts(spark, d).cube("subject", "outcome").agg(F.count("*").alias("n"), F.min("attempt_no").alias("first_attempt"), F.max("attempt_no").alias("last_attempt"), F.min("start_frame").alias("first_frame"), F.max("end_frame").alias("last_frame"), F.grouping_id().alias("_g"))
    return a.filter("_g in (0, 2, 3)").drop("_g")


@query(_AT + """ SELECT subject, attempt_no, frame, message_type AS stage, row_number() OVER (PARTITION BY subject, attempt_no, message_type ORDER BY frame) AS occurrence FROM lab WHERE message_type IN ('view', 'click', 'purchase')""")
def stage_occurrences(spark, d):
    """Each stage event of an attempt with its number among those of its stage."""
    seen = _labelled(spark, d).filter(F.col("message_type").isin(STAGES)).select("subject", "attempt_no", "frame", F.col("message_type").alias("stage"))
    return R.with_occurrence(seen, ["subject", "attempt_no", "stage"], ["frame"])


SQL["timeline_page"] = SQL["timeline_topk"].replace("WHERE ordinal < 50", "WHERE ordinal >= 10 AND ordinal < 30")


@query()
def timeline_page(spark, d):
    """The items 10 to 29 of each subject's timeline."""
    e = canonical(spark, d)
    events = e.select("subject", "frame", F.lit("event").alias("item"), F.col("message_type").alias("label"))
    found = e.filter("status >= 400").select("subject", "frame", F.lit("candidate").alias("item"), F.when(F.col("status") >= 500, "critical").otherwise("error").alias("label"))
    return R.timeline([events, found], ["subject"], ["frame", "item"], 30, skip=10)
