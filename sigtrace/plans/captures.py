"""Queries over decoded captures: records, HTTP/2 streams, identifiers, edges, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.functions import messages as M
from sigtrace.functions import scenario as Z
from sigtrace.functions import text as X
from sigtrace.functions.numbers import number_text
from sigtrace.operators import identity as I
from sigtrace.operators import joins as J
from sigtrace.operators.components import smallest_labels
from sigtrace.operators.drift import aliases
from sigtrace.operators.ranking import ordered_digest
from sigtrace.operators.transactions import assemble_streams, state_of
from sigtrace.plans.records import file_drift
from sigtrace.sources.jsonl import split_lines
from sigtrace.sources.shared import RunFolder

Q: dict = {}
SQL: dict[str, str] = {}

# Names of PFCP message types.
PFCP_NAMES = {"1": "HEARTBEAT_REQUEST", "2": "HEARTBEAT_RESPONSE", "50": "SESSION_ESTABLISHMENT_REQUEST", "51": "SESSION_ESTABLISHMENT_RESPONSE", "52": "SESSION_MODIFICATION_REQUEST", "53": "SESSION_MODIFICATION_RESPONSE", "54": "SESSION_DELETION_REQUEST", "55": "SESSION_DELETION_RESPONSE"}
# PFCP message types that are responses (TS 29.244, table 7.3-1).
PFCP_RESPONSES = ["2", "4", "6", "8", "10", "11", "13", "15", "17", "51", "53", "55", "57"]

NUM = "CASE WHEN trim({0}) ILIKE '0x%' THEN CAST(CAST(lower(trim({0})) AS UBIGINT) AS VARCHAR) ELSE CAST(TRY_CAST(trim({0}) AS UBIGINT) AS VARCHAR) END"


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(f"""WITH n AS (SELECT {NUM.format('msg_type')} AS code FROM pfcp_messages)
    SELECT CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PFCP_NAMES.items())} ELSE 'PFCP_UNKNOWN_' || code END AS message_type, count(*) AS n FROM n GROUP BY 1""")
def pfcp_type_names(spark, d):
    n = read(spark, d, "pfcp_messages").select(X.named_code(number_text(F.col("msg_type")), PFCP_NAMES, "PFCP").alias("message_type"))
    return n.groupBy("message_type").agg(F.count("*").alias("n"))


@query("""SELECT row_id, TRY_CAST(time_epoch AS DECIMAL(28,9)) AS seconds,
    CASE WHEN time_epoch IS NULL THEN NULL WHEN n = 0 THEN 'seconds' WHEN n <= 3 THEN 'milliseconds' WHEN n <= 6 THEN 'microseconds' ELSE 'nanoseconds' END AS time_precision
    FROM (SELECT row_id, time_epoch, length(rtrim(regexp_extract(time_epoch, '\\.([0-9]*)', 1), '0')) AS n FROM pfcp_messages)""")
def time_precisions(spark, d):
    return read(spark, d, "pfcp_messages").select("row_id", X.decimal_seconds(F.col("time_epoch")).alias("seconds"), X.time_precision(F.col("time_epoch")).alias("time_precision"))


@query("""SELECT analysis_id, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame, min(TRY_CAST(time_epoch AS DECIMAL(28,9))) AS first_time,
    max(TRY_CAST(time_epoch AS DECIMAL(28,9))) AS last_time, count(*) FILTER (is_heartbeat) AS n_heartbeats FROM pfcp_messages GROUP BY analysis_id""")
def capture_metadata(spark, d):
    t = X.decimal_seconds(F.col("time_epoch"))
    return read(spark, d, "pfcp_messages").groupBy("analysis_id").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min(t).alias("first_time"), F.max(t).alias("last_time"), F.count_if("is_heartbeat").alias("n_heartbeats"))


@query("""SELECT analysis_id, CASE WHEN transport.src_ip IS NOT NULL AND transport.dst_ip IS NOT NULL THEN least(transport.src_ip, transport.dst_ip) || '->' || greatest(transport.src_ip, transport.dst_ip) END AS node_pair,
    count(*) AS n, count(*) FILTER (is_heartbeat) AS n_heartbeats, min(frame) AS first_frame, max(frame) AS last_frame FROM pfcp_messages GROUP BY 1, 2""")
def node_pairs(spark, d):
    pair = X.pair_key(F.col("transport.src_ip"), F.col("transport.dst_ip"))
    return read(spark, d, "pfcp_messages").groupBy("analysis_id", pair.alias("node_pair")).agg(F.count("*").alias("n"), F.count_if("is_heartbeat").alias("n_heartbeats"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def _first(column: str, *suffixes: str) -> str:
    """SQL for the first scalar of a tree whose key ends with one of the suffixes; nulls are passed over."""
    ends = "|".join("[^a-z0-9\"]*".join(x for x in s.lower() if x.isalnum()) for s in suffixes)
    plain = f"replace({column}, chr(92) || chr(34), chr(34))"
    found = f"regexp_extract({plain}, '(?i)\"[^\"]*(?:{ends})[^a-z0-9\"]*\"\\s*:\\s*(?:\\[\\s*)?(\"[^\"{{}}\\[\\]]*\"|-?[0-9][0-9.eE+-]*|true|false)', 1)"
    return f"CASE WHEN json_valid({column}) AND {found} <> '' THEN trim({found}, '\"') END"


@query(f"""WITH t AS (SELECT analysis_id, frame, {NUM.format('msg_type')} AS typ, {NUM.format("nullif(response_to, 'None')")} AS answered, {NUM.format('seq_num')} AS own_seq,
        CASE WHEN transport.src_ip IS NOT NULL AND transport.dst_ip IS NOT NULL THEN least(transport.src_ip, transport.dst_ip) || '->' || greatest(transport.src_ip, transport.dst_ip) END AS pair,
        {_first('pfcp', 'cpseid', 'cp-f-seid', 'f-seid')} AS cp, {_first('pfcp', 'upseid', 'up-f-seid')} AS up, seid AS own, {_first('pfcp', 'pdusessionid', 'pdu-session-id')} AS pdu,
        coalesce(trim({_first('pfcp', 'cause')}), regexp_extract(pfcp, '"cause"\\s*:\\s*"([^"]*)"', 1), '') AS cause FROM pfcp_messages),
    n AS (SELECT *, coalesce({NUM.format('cp')}, {NUM.format('up')}, {NUM.format('own')}, nullif({NUM.format('pdu')}, '0')) AS own_seid,
        coalesce(typ IN ({', '.join(f"'{x}'" for x in PFCP_RESPONSES)}), false) AS response FROM t)
    SELECT analysis_id, answered AS response_to, CASE WHEN answered IS NULL THEN pair END AS node_pair, CASE WHEN answered IS NULL THEN own_seq END AS seq, CASE WHEN answered IS NULL THEN own_seid END AS seid,
        count(*) AS n_messages, min(frame) AS first_frame, count(*) FILTER (response) AS n_responses,
        CASE WHEN bool_or(lower(trim(cause)) NOT IN ('', 'none', '1', 'request_accepted', 'accepted', 'success', 'successful')) THEN 'failure'
            WHEN bool_or(response AND lower(trim(cause)) IN ('1', 'request_accepted', 'accepted', 'success', 'successful')) THEN 'success' ELSE 'unknown' END AS outcome
    FROM n GROUP BY ALL""")
def pfcp_transactions(spark, d):
    """All messages by what they answer, else by node pair, sequence and SEID; the parts of the key not used are null.

    The SEID is that of the tree, else the message's, else the PDU session.
    Texts that name one number are one. A tree that can't be read keeps the cause in its text.
    """
    wanted = {"cp": ["cpseid", "cp-f-seid", "f-seid"], "up": ["upseid", "up-f-seid"], "pdu": ["pdusessionid", "pdu-session-id"], "cause": ["cause"]}
    m = read(spark, d, "pfcp_messages").select("analysis_id", "frame", "seq_num", "msg_type", "seid", "response_to", "pfcp", X.pair_key(F.col("transport.src_ip"), F.col("transport.dst_ip")).alias("pair"), X.first_values(F.col("pfcp"), wanted).alias("v"))
    answered = number_text(F.nullif(F.col("response_to"), F.lit("None")))
    seid = F.coalesce(number_text(F.col("v.cp")), number_text(F.col("v.up")), number_text(F.col("seid")), F.nullif(number_text(F.col("v.pdu")), F.lit("0")))
    cause = F.coalesce(F.trim("v.cause"), F.regexp_extract("pfcp", r'"cause"\s*:\s*"([^"]*)"', 1), F.lit(""))
    m = m.select("analysis_id", "frame", "pair", answered.alias("response_to"), number_text(F.col("seq_num")).alias("seq"), seid.alias("seid"), number_text(F.col("msg_type")).alias("typ"), cause.alias("cause"))
    own = lambda c: F.when(F.col("response_to").isNull(), F.col(c))
    response = F.coalesce(F.col("typ").isin(PFCP_RESPONSES), F.lit(False))
    said = M.reply_cause_class(F.col("cause"), others="failure")
    outcome = F.when(F.bool_or(said == "failure"), "failure").when(F.bool_or(response & (said == "success")), "success").otherwise("unknown")
    g = m.groupBy("analysis_id", "response_to", own("pair").alias("node_pair"), own("seq").alias("seq"), own("seid").alias("seid"))
    return g.agg(F.count("*").alias("n_messages"), F.min("frame").alias("first_frame"), F.count_if(response).alias("n_responses"), outcome.alias("outcome"))


@query("""WITH t AS (SELECT row_id, lower(ngap) AS t FROM ngap_messages)
    SELECT row_id, CASE WHEN contains(t, 'unsuccessfuloutcome') THEN 'failure' WHEN contains(t, 'successfuloutcome') THEN 'success' WHEN contains(t, 'initiatingmessage') THEN 'request' ELSE 'unknown' END AS outcome FROM t""")
def ngap_outcomes(spark, d):
    return read(spark, d, "ngap_messages").select("row_id", M.pdu_outcome(M.pdu_class(F.col("ngap"))).alias("outcome"))


_WALKS = {"cp_seid": ("pfcp", "cpseid"), "up_seid": ("pfcp", "upseid"), "ue_ip": ("pfcp", "ueip"), "pdu_session_id": ("pfcp", "pdusessionid"), "amf_ue_ngap_id": ("ngap", "amfuengapid"), "ran_ue_ngap_id": ("ngap", "ranuengapid"), "procedure_code": ("ngap", "procedurecode")}


@query("WITH w AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id, '{k}' AS kind, {_first(t, suffix)} AS lookup_value FROM {t}_messages" for k, (t, suffix) in _WALKS.items()) + """)
    SELECT *, CASE WHEN kind IN ('amf_ue_ngap_id', 'ran_ue_ngap_id') THEN 'ACCESS_CONTEXT' WHEN kind = 'pdu_session_id' THEN 'PDU_SESSION' ELSE 'PFCP_SESSION' END AS node_type FROM w WHERE lookup_value IS NOT NULL AND lookup_value <> ''""")
def tree_identifiers(spark, d):
    """Identifiers from the trees, the first of each kind in document order."""
    p = read(spark, d, "pfcp_messages").select("row_id", X.first_values(F.col("pfcp"), {"cp_seid": ["cpseid"], "up_seid": ["upseid"], "ue_ip": ["ueip"], "pdu_session_id": ["pdusessionid"]}).alias("v"))
    n = read(spark, d, "ngap_messages").select("row_id", X.first_values(F.col("ngap"), {"amf_ue_ngap_id": ["amfuengapid"], "ran_ue_ngap_id": ["ranuengapid"], "procedure_code": ["procedurecode"]}).alias("v"))
    kinds = ["amf_ue_ngap_id", "ran_ue_ngap_id", "procedure_code"]
    a = I.to_long(p.select(F.lit("pfcp").alias("table_name"), "row_id", "v.*"), ["table_name", "row_id"], ["cp_seid", "up_seid", "ue_ip", "pdu_session_id"])
    b = I.to_long(n.select(F.lit("ngap").alias("table_name"), "row_id", "v.*"), ["table_name", "row_id"], kinds)
    return a.unionByName(b).withColumn("node_type", I.node_type(F.col("kind")))


@query("""SELECT row_id, response.status AS status, request.method AS method,
    CASE WHEN request IS NULL THEN 'unknown' WHEN response.status BETWEEN 200 AND 399 THEN 'success' WHEN response.status BETWEEN 400 AND 599 THEN 'failure' ELSE 'unknown' END AS outcome,
    CASE WHEN completion.rst_stream THEN 'reset' WHEN completion.capture_truncated THEN 'truncated' WHEN completion.request_end_stream AND completion.response_end_stream THEN 'complete'
         WHEN response IS NULL THEN 'request_only' ELSE 'partial' END AS completion_state FROM http2_streams""")
def http_outcomes(spark, d):
    h = read(spark, d, "http2_streams")
    done = F.when(F.col("completion.rst_stream"), "reset").when(F.col("completion.capture_truncated"), "truncated").when(F.col("completion.request_end_stream") & F.col("completion.response_end_stream"), "complete").when(F.col("response").isNull(), "request_only").otherwise("partial")
    return h.select("row_id", F.col("response.status").alias("status"), F.col("request.method").alias("method"), X.status_class(F.col("response.status"), F.col("request").isNull()).alias("outcome"), done.alias("completion_state"))


@query("""WITH u AS (SELECT row_id, request.uri AS uri, request.headers AS h FROM http2_streams)
    SELECT row_id, nullif(regexp_extract(uri, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '') AS path,
    nullif(regexp_extract(nullif(regexp_extract(uri, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), ''), '^/*([^/]+)', 1), '') AS api,
    nullif(regexp_extract(nullif(regexp_extract(uri, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), ''), '.*/sm-contexts/([^/]*)', 1), '') AS sm_context,
    list_filter(h, lambda x: lower(x.name) IN ('content-type', 'accept'))[1].value AS content FROM u""")
def http_paths(spark, d):
    h = read(spark, d, "http2_streams").select("row_id", X.url_path(F.col("request.uri")).alias("path"), F.col("request.headers").alias("h"), F.col("request.uri").alias("uri"))
    return h.select("row_id", "path", X.first_segment(F.col("path")).alias("api"), X.after_segment(F.col("path"), "sm-contexts").alias("sm_context"), X.header(F.col("h"), "content-type", "accept").alias("content"))


@query("""WITH u AS (SELECT row_id, regexp_extract(request.uri, '\\?([^#]*)', 1) AS q FROM http2_streams), p AS (SELECT row_id, list_filter(string_split(q, '&'), lambda x: x <> '') AS parts FROM u WHERE q <> ''),
    e AS (SELECT row_id, unnest(parts) AS part, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position FROM p)
    SELECT row_id, position, url_decode(replace(split_part(part, '=', 1), '+', ' ')) AS name, url_decode(replace(regexp_extract(part, '=(.*)$', 1), '+', ' ')) AS value FROM e""")
def http_query_parameters(spark, d):
    """Parameters of request targets, repeats kept. The tables' targets have none; tested on fixtures too."""
    h = read(spark, d, "http2_streams")
    return h.select("row_id", F.posexplode(X.url_query(F.col("request.uri")))).select("row_id", F.col("pos").alias("position"), "col.name", "col.value")


@query("""WITH s AS (SELECT row_id, 'request' AS side, unnest(request.body.segments) AS g FROM http2_streams UNION ALL SELECT row_id, 'response', unnest(response.body.segments) FROM http2_streams),
    a AS (SELECT row_id, min(g.frame) FILTER (side = 'request') AS request_first_frame, max(g.frame) FILTER (side = 'response') AS response_last_frame,
        coalesce(string_agg(g.raw_hex, '' ORDER BY g.frame, g.raw_hex) FILTER (side = 'request'), '') AS request_hex, coalesce(string_agg(g.raw_hex, '' ORDER BY g.frame, g.raw_hex) FILTER (side = 'response'), '') AS response_hex FROM s GROUP BY row_id)
    SELECT *, length(request_hex) // 2 AS request_bytes, sha256(unhex(response_hex)) AS response_sha256 FROM a""")
def stream_assembly(spark, d):
    h = read(spark, d, "http2_streams")
    part = lambda side: h.select("row_id", F.lit(side).alias("side"), F.explode(f"{side}.body.segments").alias("g"))
    f = part("request").unionAll(part("response")).select("row_id", "side", F.col("g.frame").alias("frame"), F.lit(None).cast("decimal(28,9)").alias("time"), F.col("g.raw_hex").alias("data"), F.lit(False).alias("end_stream"), F.lit(False).alias("reset"))
    return assemble_streams(f, ["row_id"]).select("row_id", "request_first_frame", "response_last_frame", "request_hex", "response_hex", "request_bytes", "response_sha256")


@query("""SELECT row_id, response.body.byte_length AS byte_length, response.body.content_type AS content_type, octet_length(encode(response.body.decoded_json)) <= 200 AS small,
    CASE WHEN octet_length(encode(response.body.decoded_json)) <= 200 THEN response.body.decoded_json END AS decoded,
    CASE WHEN response.body.multipart IS NOT NULL THEN CAST(coalesce(CASE WHEN json_valid(response.body.multipart) AND json_type(response.body.multipart) = 'ARRAY' THEN json_array_length(response.body.multipart) END, 1) AS INTEGER) END AS parts
    FROM http2_streams WHERE response.body IS NOT NULL""")
def body_summaries(spark, d):
    b = M.body_summary(F.col("response.body"), 200)
    return read(spark, d, "http2_streams").select("row_id", b.alias("b")).filter("b is not null").select("row_id", "b.byte_length", "b.content_type", "b.small", "b.decoded", "b.parts")


@query("""WITH n AS (SELECT nullif(regexp_extract(nullif(regexp_extract(request.uri, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), ''), '^/*([^/]+)', 1), '') AS api, response.status AS status, completion.state AS state FROM http2_streams)
    SELECT api, count(*) AS n, count(*) FILTER (status >= 400) AS n_failed, count(*) FILTER (state IS DISTINCT FROM 'complete') AS n_incomplete,
    CASE WHEN count(*) FILTER (status >= 500) > 0 THEN 'failure' WHEN count(*) FILTER (status >= 400) > 0 THEN 'degraded' ELSE 'success' END AS health FROM n GROUP BY api""")
def dependency_health(spark, d):
    h = read(spark, d, "http2_streams").select(X.first_segment(X.url_path(F.col("request.uri"))).alias("api"), F.col("response.status").alias("status"), F.col("completion.state").alias("state"))
    health = state_of({"failure": F.count_if(F.col("status") >= 500) > 0, "degraded": F.count_if(F.col("status") >= 400) > 0})
    return h.groupBy("api").agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("n_failed"), F.count_if(~F.col("state").eqNullSafe(F.lit("complete"))).alias("n_incomplete"), health.alias("health"))


_OBS = """o AS (SELECT event_id, kind, lookup_value, min(observation_id) AS observation_id, any_value(node_type) AS node_type, any_value(scope_key) AS scope_key, min(frame) AS frame FROM identity_observations
    WHERE event_id IS NOT NULL GROUP BY event_id, kind, lookup_value)"""


def _obs(spark, d):
    o = read(spark, d, "identity_observations").filter("event_id is not null")
    return o.groupBy("event_id", "kind", "lookup_value").agg(F.min("observation_id").alias("observation_id"), F.min("frame").alias("frame"))


@query("SELECT kind, count(*) AS n_rows, count(DISTINCT (event_id, lookup_value)) AS n_distinct FROM identity_observations GROUP BY kind")
def observation_kinds(spark, d):
    o = read(spark, d, "identity_observations")
    one = I.observations(o, ["event_id"]).groupBy("kind").agg(F.count("*").alias("n_distinct"))
    return o.groupBy("kind").agg(F.count("*").alias("n_rows")).join(one, "kind", "left").select("kind", "n_rows", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


_TYPE = "CASE WHEN kind IN ('supi', 'suci', 'gpsi', 'guti', 'pei') THEN 'UE' WHEN kind IN ('amf_ue_ngap_id', 'ran_ue_ngap_id') THEN 'ACCESS_CONTEXT' WHEN kind = 'pdu_session_id' THEN 'PDU_SESSION' WHEN kind = 'sm_context_ref' THEN 'SM_CONTEXT' ELSE 'PFCP_SESSION' END"


@query(f"""WITH o AS (SELECT event_id, kind, lookup_value, {_TYPE} AS t, min(observation_id) AS id FROM identity_observations WHERE event_id IS NOT NULL GROUP BY ALL)
    SELECT a.event_id, a.kind AS left_kind, b.kind AS right_kind, count(*) AS n_pairs FROM o a JOIN o b ON a.event_id = b.event_id
        AND (a.t < b.t OR a.t = 'ACCESS_CONTEXT' AND b.t = 'ACCESS_CONTEXT' AND (a.kind < b.kind OR a.kind = b.kind AND a.lookup_value < b.lookup_value))
    GROUP BY a.event_id, a.kind, b.kind""")
def cooccurrence_pairs(spark, d):
    """How many pairs of observations each event links, by kinds; a large event's pairs are counted, not built."""
    return I.linked(_obs(spark, d), "event_id", "kind")


@query("""WITH o AS (SELECT DISTINCT observation_id, kind, lookup_value, scope_key, frame FROM identity_observations), c AS (
    SELECT kind, observation_id AS left_id, lead(observation_id) OVER (PARTITION BY kind, lookup_value, scope_key ORDER BY frame, observation_id) AS right_id FROM o)
    SELECT kind, left_id, right_id FROM c WHERE right_id IS NOT NULL""")
def identity_chain(spark, d):
    """The edges between consecutive observations of each identifier."""
    o = read(spark, d, "identity_observations").select("observation_id", "kind", "lookup_value", "scope_key", "frame").distinct()
    return I.chain(o, ["kind", "lookup_value", "scope_key"], "frame", "observation_id").select("kind", "left_id", "right_id")


@query("""SELECT kind, lookup_value, scope_key, min(frame) AS first_frame, max(frame) AS last_frame, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
    coalesce(bool_or(provisional), false) AS provisional, count(DISTINCT observation_id) AS n_observations FROM identity_observations GROUP BY 1, 2, 3""")
def identity_nodes(spark, d):
    return I.node_table(read(spark, d, "identity_observations"), ["kind", "lookup_value", "scope_key"])


@query("""WITH n AS (SELECT node_type, lookup_value, min(frame) AS first_frame FROM identity_observations GROUP BY 1, 2)
    SELECT node_type, lookup_value, first_frame, node_type || '-' || row_number() OVER (PARTITION BY node_type ORDER BY first_frame, lookup_value) AS display_alias FROM n""")
def node_aliases(spark, d):
    n = read(spark, d, "identity_observations").groupBy("node_type", "lookup_value").agg(F.min("frame").alias("first_frame"))
    return I.aliases(n, "node_type", "first_frame", "lookup_value")


@query(f"""WITH o AS (SELECT event_id, kind, lookup_value, scope_key, {_TYPE} AS t, min(frame) AS frame FROM identity_observations WHERE event_id IS NOT NULL AND lookup_value IS NOT NULL GROUP BY ALL),
    b AS (SELECT a.kind AS access_kind, a.lookup_value AS access_id, a.scope_key, u.kind AS ue_kind, u.lookup_value AS value, a.frame FROM o a JOIN o u ON a.event_id = u.event_id AND a.t = 'ACCESS_CONTEXT' AND u.t = 'UE')
    SELECT access_kind, access_id, scope_key, ue_kind, count(DISTINCT value) AS n_values, arg_min(value, (frame, value)) AS first_value FROM b GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def identity_conflicts(spark, d):
    """Access identifiers, each in its scope, bound to several values of one kind of subscriber identifier."""
    o = read(spark, d, "identity_observations").filter("event_id is not null and lookup_value is not null").withColumn("type", I.node_type(F.col("kind")))
    key = F.struct(F.col("kind").alias("access_kind"), F.col("lookup_value").alias("access_id"), "scope_key").alias("k")
    a = o.filter("type = 'ACCESS_CONTEXT'").groupBy("event_id", key).agg(F.min("frame").alias("frame"))
    u = o.filter("type = 'UE'").select("event_id", "kind", F.col("lookup_value").alias("value")).distinct()
    c = I.bound_conflicts(a, u, "event_id")
    return c.select("k.access_kind", "k.access_id", "k.scope_key", F.col("kind").alias("ue_kind"), "n_values", "first_value")


@query(f"""WITH RECURSIVE o AS (SELECT DISTINCT event_id, kind || ':' || lookup_value AS k FROM identity_observations WHERE event_id IS NOT NULL AND lookup_value IS NOT NULL AND {_TYPE} = 'ACCESS_CONTEXT'),
    h AS (SELECT event_id, min(k) AS h FROM o GROUP BY event_id), p AS (SELECT h.h AS x, o.k AS y FROM o JOIN h USING (event_id)), e AS (SELECT DISTINCT x, y FROM (SELECT x, y FROM p UNION ALL SELECT y, x FROM p)),
    g(id, label) USING KEY (id) AS (SELECT DISTINCT x, x FROM e UNION
        SELECT e.y, min(g.label) FROM g JOIN e ON e.x = g.id JOIN recurring.g AS r ON r.id = e.y WHERE g.label < r.label GROUP BY e.y)
    SELECT id AS v, label FROM g""")
def access_components(spark, d):
    """Access identifiers that share events, directly or through others, each with the smallest of its group."""
    o = _obs(spark, d).filter((I.node_type(F.col("kind")) == "ACCESS_CONTEXT") & F.col("lookup_value").isNotNull()).withColumn("key", F.concat_ws(":", "kind", "lookup_value"))
    return smallest_labels(I.star(o, "event_id", "key"), RunFolder(spark, "access"))


@query("""WITH s AS (SELECT DISTINCT analysis_id, kind || ':' || lookup_value AS value, valid_from_frame AS lo, valid_to_frame AS hi FROM identity_observations WHERE valid_from_frame IS NOT NULL),
    p AS (SELECT DISTINCT analysis_id, frame FROM ngap_messages WHERE analysis_id IS NOT NULL AND frame IS NOT NULL)
    SELECT p.analysis_id, p.frame, count(*) AS n_valid, min(value) AS first_valid FROM p JOIN s ON p.analysis_id = s.analysis_id AND p.frame >= lo AND (hi IS NULL OR p.frame <= hi) GROUP BY 1, 2""")
def valid_at(spark, d):
    """How many identifiers are valid at each NGAP message's frame, and the first of them."""
    s = read(spark, d, "identity_observations").filter("valid_from_frame is not null").select("analysis_id", F.concat("kind", F.lit(":"), "lookup_value").alias("value"), F.col("valid_from_frame").alias("lo"), F.col("valid_to_frame").alias("hi")).distinct()
    p = read(spark, d, "ngap_messages").filter("frame is not null and analysis_id is not null").select("analysis_id", "frame")
    return J.valid_counts(p, s.filter("analysis_id is not null"), ["analysis_id"], "frame", "lo", "hi", "value", 1 << 16)


@query("""WITH x AS (SELECT edge_id, unnest(supporting_event_ids) AS event_id FROM identity_edges), o AS (SELECT event_id, count(*) AS n, min(frame) AS f FROM identity_observations GROUP BY event_id)
    SELECT edge_id, count(*) AS n_ids, count(o.event_id) AS n_resolved, sum(coalesce(n, 0)) AS n_observations, min(f) AS first_frame FROM x LEFT JOIN o USING (event_id) GROUP BY edge_id""")
def evidence_resolution(spark, d):
    x = read(spark, d, "identity_edges").select("edge_id", F.explode("supporting_event_ids").alias("event_id"))
    o = read(spark, d, "identity_observations").groupBy("event_id").agg(F.count("*").alias("n"), F.min("frame").alias("f"), F.lit(1).alias("there"))
    g = x.join(o, "event_id", "left").groupBy("edge_id")
    return g.agg(F.count("*").alias("n_ids"), F.count("there").alias("n_resolved"), F.sum(F.coalesce("n", F.lit(0))).alias("n_observations"), F.min("f").alias("first_frame"))


@query("""SELECT relation, decision, edge_effect, count(*) AS n, CAST(min(confidence) AS DOUBLE) AS least, CAST(sum(confidence) AS DOUBLE) AS total FROM identity_edges GROUP BY GROUPING SETS ((relation, decision, edge_effect), (relation), ())""")
def edge_decisions(spark, d):
    e = read(spark, d, "identity_edges")
    g = e.cube("relation", "decision", "edge_effect").agg(F.count("*").alias("n"), F.min("confidence").cast("double").alias("least"), F.sum("confidence").cast("double").alias("total"), F.grouping_id().alias("_g"))
    return g.filter("_g in (0, 3, 7)").drop("_g")


@query("""SELECT analysis_id, CASE WHEN status = 'failed' THEN 'failed' WHEN completed_at IS NULL THEN 'partial' WHEN revision IS NULL THEN 'partial' ELSE 'success' END AS folded,
    regexp_extract(lower(decoder.tshark_version), '([0-9]+\\.[0-9]+\\.[0-9]+)', 1) AS dissector, elapsed_ms FROM decoder_manifests""")
def manifest_states(spark, d):
    m = read(spark, d, "decoder_manifests")
    folded = state_of({"failed": F.col("status") == "failed", "partial": F.col("completed_at").isNull() | F.col("revision").isNull()})
    return m.select("analysis_id", folded.alias("folded"), F.regexp_extract(F.lower("decoder.tshark_version"), r"([0-9]+\.[0-9]+\.[0-9]+)", 1).alias("dissector"), "elapsed_ms")


@query("SELECT stream_id, sha256(string_agg(sha256(relative_path), chr(10) ORDER BY relative_path, file_id)) AS digest, sum(record_count) AS n_records FROM raw_files GROUP BY stream_id")
def member_digests(spark, d):
    f = read(spark, d, "raw_files")
    n = f.groupBy("stream_id").agg(F.sum("record_count").alias("n_records"))
    return ordered_digest(f, "stream_id", ["relative_path", "file_id"], "relative_path").join(n, "stream_id")


@query("""WITH s AS (SELECT file_id, CASE WHEN line IS NULL OR trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) THEN 'not_json' WHEN json_type(line) = 'OBJECT' THEN 'ok' ELSE 'not_object' END AS state FROM raw_lines)
    SELECT file_id, state, count(*) AS n FROM s GROUP BY 1, 2""")
def quarantine_counts(spark, d):
    return split_lines(read(spark, d, "raw_lines")).groupBy("file_id", "state").agg(F.count("*").alias("n"))


def _words(words: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{v}'" for w, v in words.items()) + " END"


def _match(rx: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(t, '{rx}', {group}), '')"


_SCENARIO = f"""WITH x AS (SELECT doc_id, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, {_words(Z.PROCEDURES)} AS procedure, TRY_CAST({_match(Z.PDU_SESSION)} AS BIGINT) AS pdu_session, coalesce(TRY_CAST({_match(Z.FRAME_RANGE)} AS BIGINT), TRY_CAST({_match(Z.FRAME)} AS BIGINT)) AS frame_from,
        coalesce(TRY_CAST({_match(Z.FRAME_RANGE, 2)} AS BIGINT), TRY_CAST({_match(Z.FRAME)} AS BIGINT)) AS frame_to, {_match(Z.DNN)} AS dnn, {_match(Z.SLICE)} AS s_nssai, {_words(Z.OUTCOMES)} AS expected_outcome, {_words(Z.ACCESS)} AS access_type,
        {_words(Z.INITIATORS)} AS initiator, CASE WHEN contains(t, 'pdu') AND contains(t, 'ipv4') THEN 'ipv4' END AS pdu_type, CASE WHEN contains(t, 'emergency') THEN true END AS emergency, CASE WHEN contains(t, 'smf') THEN 'smf' END AS failure_stage,
        CASE WHEN contains(t, 'no registration reject') OR contains(t, 'without registration reject') THEN 'REGISTRATION_REJECT' END AS forbidden FROM x),
    n AS (SELECT *, {' + '.join(f'CAST({f} IS NOT NULL AS INTEGER)' for f in Z.FACTS)} AS n_facts FROM f)"""


@query(_SCENARIO + " SELECT *, CASE WHEN n_facts >= 3 THEN 'high' WHEN n_facts >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM n")
def scenario_facts(spark, d):
    """Facts named in free texts, over whole texts."""
    return read(spark, d, "documents").filter("text is not null").select("doc_id", Z.facts(F.col("text")).alias("f")).select("doc_id", "f.*")


@query()
def p5_fields(spark, d):
    """The alias table behind p5_table: each name of a field by protocol, in how many files, its usual name and type."""
    folder = RunFolder(spark, "fields")
    return aliases(read(spark, d, "raw_files"), file_drift(spark, d), folder.write)


@query("""WITH h AS (SELECT unnest(request.headers) AS h FROM http2_streams UNION ALL SELECT unnest(response.headers) FROM http2_streams)
    SELECT regexp_replace(lower(h.name), '[^\\p{L}\\p{N}]', '', 'g') AS name, count(*) AS n, count(DISTINCT h.value) AS n_values FROM h GROUP BY 1""")
def header_names(spark, d):
    """Headers by their normalised names."""
    h = read(spark, d, "http2_streams")
    each = h.select(F.explode("request.headers").alias("h")).unionAll(h.select(F.explode("response.headers")))
    return each.groupBy(X.normal_key(F.col("h.name")).alias("name")).agg(F.count("*").alias("n"), F.count_distinct("h.value").alias("n_values"))


@query("""WITH s AS (SELECT DISTINCT analysis_id, kind || ':' || lookup_value AS value, valid_from_frame AS lo, valid_to_frame AS hi FROM identity_observations WHERE valid_from_frame IS NOT NULL AND valid_to_frame IS NOT NULL AND analysis_id IS NOT NULL),
    p AS (SELECT DISTINCT analysis_id, frame FROM identity_observations WHERE frame IS NOT NULL AND analysis_id IS NOT NULL),
    j AS (SELECT p.analysis_id, p.frame, value, lo, row_number() OVER (PARTITION BY p.analysis_id, p.frame ORDER BY lo DESC, value) AS n FROM p JOIN s ON p.analysis_id = s.analysis_id AND p.frame BETWEEN lo AND hi)
    SELECT analysis_id, frame, value, lo FROM j WHERE n = 1""")
def latest_valid_identifier(spark, d):
    """At each frame with an observation the identifier whose closed validity began last."""
    o = read(spark, d, "identity_observations").filter("analysis_id is not null")
    s = o.filter("valid_from_frame is not null and valid_to_frame is not null").select("analysis_id", F.concat("kind", F.lit(":"), "lookup_value").alias("value"), F.col("valid_from_frame").alias("lo"), F.col("valid_to_frame").alias("hi")).distinct()
    p = o.filter("frame is not null").select("analysis_id", "frame").distinct()
    return J.latest_valid(p, s, ["analysis_id"], "frame", "lo", "hi", F.col("value"), 1 << 12, ["analysis_id", "frame"]).select("analysis_id", "frame", "value", "lo")


@query("""SELECT rule_id, decision, count(*) AS n, CAST(min(confidence) AS DOUBLE) AS least, CASE WHEN min(confidence) >= 0.85 THEN 'high' WHEN min(confidence) >= 0.7 THEN 'medium' ELSE 'low' END AS confidence FROM identity_edges GROUP BY rule_id, decision""")
def edge_confidence(spark, d):
    """The confidence of each rule's edges: that of the weakest."""
    least = F.min("confidence")
    return read(spark, d, "identity_edges").groupBy("rule_id", "decision").agg(F.count("*").alias("n"), least.cast("double").alias("least"), F.when(least >= 0.85, "high").when(least >= 0.7, "medium").otherwise("low").alias("confidence"))


@query("""WITH r AS (SELECT DISTINCT unnest(supporting_event_ids) AS event_id FROM identity_edges WHERE decision NOT IN ('accepted', 'accepted_with_warning')),
    a AS (SELECT edge_id, unnest(supporting_event_ids) AS event_id FROM identity_edges WHERE decision IN ('accepted', 'accepted_with_warning'))
    SELECT DISTINCT edge_id FROM a WHERE event_id IN (SELECT event_id FROM r)""")
def disputed_edges(spark, d):
    """Accepted edges that share a supporting event with an edge that was not accepted: a semi join on the events."""
    e = read(spark, d, "identity_edges").select("edge_id", F.col("decision").isin("accepted", "accepted_with_warning").alias("ok"), F.explode("supporting_event_ids").alias("event_id"))
    return e.filter("ok").join(e.filter("not ok").select("event_id").distinct(), "event_id", "left_semi").select("edge_id").distinct()


@query("""WITH p AS (SELECT analysis_id, CASE WHEN transport.src_ip IS NOT NULL AND transport.dst_ip IS NOT NULL THEN least(transport.src_ip, transport.dst_ip) || '->' || greatest(transport.src_ip, transport.dst_ip) END AS pair, frame, is_heartbeat FROM pfcp_messages WHERE frame IS NOT NULL),
    m AS (SELECT * FROM p WHERE pair IS NOT NULL AND analysis_id IS NOT NULL), s AS (SELECT analysis_id, pair, min(frame) AS lo FROM m WHERE is_heartbeat GROUP BY ALL)
    SELECT m.analysis_id, m.pair AS node_pair, count(*) AS n, count(*) FILTER (is_heartbeat) AS n_heartbeats FROM m JOIN s ON m.analysis_id = s.analysis_id AND m.pair = s.pair AND m.frame BETWEEN s.lo AND s.lo + 500 GROUP BY 1, 2""")
def pair_windows(spark, d):
    """The messages of each node pair within 500 frames of its first heartbeat: a range read by pair."""
    m = read(spark, d, "pfcp_messages").select("analysis_id", X.pair_key(F.col("transport.src_ip"), F.col("transport.dst_ip")).alias("node_pair"), "frame", "is_heartbeat").filter("frame is not null and node_pair is not null and analysis_id is not null")
    s = m.filter("is_heartbeat").groupBy("analysis_id", "node_pair").agg(F.min("frame").alias("lo")).withColumn("hi", F.col("lo") + 500)
    return J.in_interval(m, s, ["analysis_id", "node_pair"], "frame", "lo", "hi", 512).groupBy("analysis_id", "node_pair").agg(F.count("*").alias("n"), F.count_if("is_heartbeat").alias("n_heartbeats"))
