"""Queries from decoded records to canonical events, their identifiers and nodes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.functions.text import url_path
from sigtrace.operators import canonical as C
from sigtrace.operators import identity as I
from sigtrace.operators import stages as S
from sigtrace.operators.reassembly import reassemble, stream_key
from sigtrace.operators.transactions import http_failures as failed_transactions
from sigtrace.operators.transactions import transaction_key, transactions
from sigtrace.plans import captures
from sigtrace.plans.captures import NUM, PFCP_NAMES, _first, read

Q: dict = {}
SQL: dict[str, str] = {}
KEYS = ["analysis_id", "row_id"]

# Names of NGAP procedures (TS 38.413) and NAS message types (TS 24.501), by their decimal codes.
NGAP_NAMES = {"4": "DOWNLINK_NAS_TRANSPORT", "12": "HANDOVER_PREPARATION", "14": "INITIAL_CONTEXT_SETUP", "15": "INITIAL_UE_MESSAGE", "21": "NG_SETUP", "24": "PAGING", "25": "PATH_SWITCH_REQUEST", "29": "PDU_SESSION_RESOURCE_SETUP", "41": "UE_CONTEXT_RELEASE", "46": "UPLINK_NAS_TRANSPORT"}
NAS_NAMES = {"65": "REGISTRATION_REQUEST", "66": "REGISTRATION_ACCEPT", "67": "REGISTRATION_COMPLETE", "68": "REGISTRATION_REJECT", "86": "AUTHENTICATION_REQUEST", "87": "AUTHENTICATION_RESPONSE", "93": "SECURITY_MODE_COMMAND", "94": "SECURITY_MODE_COMPLETE", "193": "PDU_SESSION_ESTABLISHMENT_REQUEST", "194": "PDU_SESSION_ESTABLISHMENT_ACCEPT", "195": "PDU_SESSION_ESTABLISHMENT_REJECT"}
# Headers that a lean view leaves out.
DULL_HEADERS = ["user-agent", "accept", "accept-encoding", "content-length", "date"]
# The APIs of the partitions beside the primary one.
PARTITIONS = {"nrf": ("nnrf-nfm", "nnrf-disc"), "udr": ("nudr-dr", "nudr-group-id-map")}
REGISTRY = C.Registry(NGAP_NAMES, NAS_NAMES, PFCP_NAMES, PARTITIONS, ("nnrf", "nudr"))


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def flat(events, *more: str):
    """An event's columns that both engines spell alike."""
    return events.select(
        "row_id", "ordinal", "protocol", "frame", "seconds", "time_precision", "src_ip", "dst_ip", "direction", "message_type", "procedure", "outcome", "cause", "part", "part_confidence", "validation_status",
        F.array_join(F.array_sort("issues"), ",").alias("issues"), *[F.col(f"identifiers.{c}").alias(c) for c in more],
    )


def _case(names: dict[str, str], code: str, prefix: str, missing: str) -> str:
    return f"CASE {code} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in names.items())} ELSE coalesce('{prefix}_UNKNOWN_' || {code}, '{missing}') END"


def _precision(c: str) -> str:
    n = f"length(rtrim(regexp_extract({c}, '\\.([0-9]*)', 1), '0'))"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {n} = 0 THEN 'seconds' WHEN {n} <= 3 THEN 'milliseconds' WHEN {n} <= 6 THEN 'microseconds' ELSE 'nanoseconds' END"


def _readable(c: str) -> str:
    return f"coalesce(CASE WHEN json_valid({c}) THEN json_type({c}) IN ('OBJECT', 'ARRAY') OR (json_type({c}) = 'VARCHAR' AND json_valid({c}->>'$') AND coalesce(json_type(CASE WHEN json_valid({c}->>'$') THEN {c}->>'$' END) IN ('OBJECT', 'ARRAY'), false)) END, false)"


def _list(*parts: str) -> str:
    return f"array_to_string(list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), ',')"


def _int(c: str) -> str:
    return f"TRY_CAST({NUM.format(c)} AS BIGINT)"


_STATUS = "CASE WHEN frame IS NULL OR NOT ok THEN 'quarantined' WHEN {issue} THEN 'partial' ELSE 'valid' END"
_PFCP = f"""p AS (SELECT row_id, analysis_id, frame, time_epoch, transport.src_ip AS src_ip, transport.dst_ip AS dst_ip, {NUM.format('msg_type')} AS code, {_readable('pfcp')} AS ok, nullif(nullif(trim(response_to), ''), 'None') AS answers, nullif(nullif(trim(response_in), ''), 'None') AS answered,
    pfcp, {_first('pfcp', 'cause')} AS cause, {_first('pfcp', 'cpseid', 'cp-f-seid', 'f-seid')} AS cp_seid, {_first('pfcp', 'upseid', 'up-f-seid')} AS up_seid, {_first('pfcp', 'ueip', 'ue-ip-address')} AS ue_ip, {_int(_first('pfcp', 'pdusessionid', 'pdu-session-id'))} AS pdu_session_id, {_int('seq_num')} AS pfcp_sequence FROM pfcp_messages),
    pe AS (SELECT *, {_case(PFCP_NAMES, 'code', 'PFCP', 'PFCP_MESSAGE')} AS message_type, code IS NOT NULL AND code NOT IN ({', '.join(f"'{k}'" for k in PFCP_NAMES)}) AS unknown FROM p)"""


@query(f"""WITH {_PFCP} SELECT row_id, 0 AS ordinal, 'PFCP' AS protocol, frame, TRY_CAST(time_epoch AS DECIMAL(28,9)) AS seconds, {_precision('time_epoch')} AS time_precision, src_ip, dst_ip, 'NF_TO_NF' AS direction, message_type, message_type AS procedure,
    CASE WHEN answers IS NOT NULL THEN CASE WHEN coalesce(regexp_matches(lower(pfcp), 'reject|failure|error'), false) THEN 'failure' ELSE 'success' END WHEN answered IS NOT NULL THEN 'request' ELSE 'unknown' END AS outcome,
    cause, CASE WHEN frame IS NOT NULL AND ok THEN 'primary' END AS part, 'high' AS part_confidence, {_STATUS.format(issue='unknown')} AS validation_status,
    {_list("CASE WHEN frame IS NULL THEN 'no_frame' END", "CASE WHEN NOT ok THEN 'unreadable_tree' END", "CASE WHEN unknown THEN 'unknown_pfcp_code' END")} AS issues, cp_seid, up_seid, ue_ip, pdu_session_id, pfcp_sequence FROM pe""")
def canonical_pfcp(spark, d):
    """PFCP records as canonical events."""
    return flat(C.pfcp_events(read(spark, d, "pfcp_messages"), REGISTRY, KEYS), "cp_seid", "up_seid", "ue_ip", "pdu_session_id", "pfcp_sequence")


_NGAP = f"""n AS (SELECT row_id, analysis_id, frame, time_epoch, transport.src_ip AS src_ip, transport.dst_ip AS dst_ip, {_readable('ngap')} AS ok, nas IS NOT NULL AS has_nas, lower(ngap) AS t,
        {_first('ngap', 'procedurecode')} AS code, {_first('ngap', 'cause')} AS cause, {_first('ngap', 'amfuengapid')} AS amf_ue_ngap_id, {_first('ngap', 'ranuengapid')} AS ran_ue_ngap_id, {_int(_first('ngap', 'pdusessionid'))} AS session,
        {_first('nas', 'message_type', 'mmmessage', 'gsmmessage')} AS nas_code, {_first('nas', 'cause', 'rejectcause')} AS nas_cause, {_first('nas', 'suci')} AS suci, {_first('nas', 'supi')} AS supi, {_first('nas', 'guti')} AS guti, {_int(_first('nas', 'pdusessionid'))} AS nas_session FROM ngap_messages),
    ne AS (SELECT row_id, analysis_id, frame, time_epoch, src_ip, dst_ip, ok, 0 AS ordinal, 'NGAP' AS protocol, {_case(NGAP_NAMES, 'code', 'NGAP', 'NGAP_PDU')} AS message_type, cause, amf_ue_ngap_id, ran_ue_ngap_id, session AS pdu_session_id, CAST(NULL AS VARCHAR) AS suci, CAST(NULL AS VARCHAR) AS supi, CAST(NULL AS VARCHAR) AS guti,
        CASE WHEN contains(t, 'unsuccessfuloutcome') THEN 'failure' WHEN contains(t, 'successfuloutcome') THEN 'success' WHEN contains(t, 'initiatingmessage') THEN 'request' ELSE 'unknown' END AS outcome,
        CASE WHEN code IS NOT NULL AND code NOT IN ({', '.join(f"'{k}'" for k in NGAP_NAMES)}) THEN 'unknown_ngap_code' END AS issue, CAST(NULL AS VARCHAR) AS hidden FROM n
    UNION ALL SELECT row_id, analysis_id, frame, time_epoch, src_ip, dst_ip, ok, 1, 'NAS', {_case(NAS_NAMES, 'nas_code', 'NAS', 'NAS_PDU')}, nas_cause, amf_ue_ngap_id, ran_ue_ngap_id, coalesce(session, nas_session), suci, supi, guti, 'unknown',
        CASE WHEN nas_code IS NOT NULL AND nas_code NOT IN ({', '.join(f"'{k}'" for k in NAS_NAMES)}) THEN 'unknown_nas_code' END, CASE WHEN nas_code IS NULL THEN 'type_not_visible' END FROM n WHERE has_nas)"""


@query(f"""WITH {_NGAP} SELECT row_id, ordinal, protocol, frame, TRY_CAST(time_epoch AS DECIMAL(28,9)) AS seconds, {_precision('time_epoch')} AS time_precision, src_ip, dst_ip, 'UNKNOWN' AS direction, message_type, message_type AS procedure, outcome, cause,
    CASE WHEN frame IS NOT NULL AND ok THEN 'primary' END AS part, 'high' AS part_confidence, {_STATUS.format(issue='issue IS NOT NULL OR hidden IS NOT NULL')} AS validation_status,
    {_list("CASE WHEN frame IS NULL THEN 'no_frame' END", "CASE WHEN NOT ok THEN 'unreadable_tree' END", "issue", "hidden")} AS issues, amf_ue_ngap_id, ran_ue_ngap_id, pdu_session_id, suci, supi, guti FROM ne""")
def canonical_ngap(spark, d):
    """NGAP records as canonical events, and the NAS messages inside them."""
    return flat(C.ngap_events(read(spark, d, "ngap_messages"), REGISTRY, KEYS), "amf_ue_ngap_id", "ran_ue_ngap_id", "pdu_session_id", "suci", "supi", "guti")


@query("""WITH h AS (SELECT row_id, coalesce(request.start_frame, response.start_frame) AS frame, coalesce(request.start_time_epoch, response.start_time_epoch) AS time_epoch, transport.client.ip AS src_ip, transport.server.ip AS dst_ip,
        coalesce(request.method, list_filter(request.headers, lambda x: lower(x.name) = ':method')[1].value) AS method, request.uri AS uri, response.status AS status, completion.state AS state, nullif(transport.original_key, '') AS http2_key,
        list_filter(list_concat(coalesce(request.headers, []), coalesce(response.headers, [])), lambda x: lower(x.name) IN ('3gpp-sbi-correlation-info', 'x-correlation-id'))[1].value AS correlation_id FROM http2_streams),
    u AS (SELECT *, nullif(regexp_extract(uri, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '') AS path FROM h), a AS (SELECT *, nullif(regexp_extract(path, '^/*([^/]+)', 1), '') AS api, nullif(regexp_extract(path, '.*/sm-contexts/([^/]*)', 1), '') AS sm_context_ref FROM u),
    r AS (SELECT *, lower(api) IN ('nnrf-nfm', 'nnrf-disc') AS nrf, lower(api) IN ('nudr-dr', 'nudr-group-id-map') AS udr, lower(api) LIKE 'nnrf%' OR lower(api) LIKE 'nudr%' AS near FROM a)
    SELECT row_id, 0 AS ordinal, 'HTTP2' AS protocol, frame, TRY_CAST(time_epoch AS DECIMAL(28,9)) AS seconds, """ + _precision("time_epoch") + """ AS time_precision, src_ip, dst_ip, 'NF_TO_NF' AS direction,
        coalesce(method, 'HTTP2') || ' ' || coalesce(path, uri, 'HTTP2_STREAM') AS message_type, api AS procedure, CASE WHEN state = 'response_only' THEN 'unknown' WHEN status BETWEEN 200 AND 399 THEN 'success' WHEN status BETWEEN 400 AND 599 THEN 'failure' ELSE 'unknown' END AS outcome,
        CAST(NULL AS VARCHAR) AS cause, CASE WHEN frame IS NULL THEN NULL WHEN nrf THEN 'nrf' WHEN udr THEN 'udr' ELSE 'primary' END AS part, CASE WHEN nrf OR udr THEN 'high' WHEN near THEN 'low' ELSE 'medium' END AS part_confidence,
        CASE WHEN frame IS NULL THEN 'quarantined' WHEN near AND NOT nrf AND NOT udr THEN 'partial' ELSE 'valid' END AS validation_status,
        array_to_string(list_sort(list_filter([CASE WHEN frame IS NULL THEN 'no_frame' END, CASE WHEN near AND NOT nrf AND NOT udr THEN 'unlisted_api' END], lambda x: x IS NOT NULL)), ',') AS issues, http2_key, correlation_id, sm_context_ref FROM r""")
def canonical_http(spark, d):
    """HTTP/2 streams as canonical events, routed by their API."""
    return flat(C.http_events(read(spark, d, "http2_streams"), REGISTRY, KEYS), "http2_key", "correlation_id", "sm_context_ref")


def canonical_all(spark, d):
    """All canonical events of the captures; one narrow plan without a shuffle."""
    e = C.pfcp_events(read(spark, d, "pfcp_messages"), REGISTRY, KEYS)
    return e.unionByName(C.ngap_events(read(spark, d, "ngap_messages"), REGISTRY, KEYS)).unionByName(C.http_events(read(spark, d, "http2_streams"), REGISTRY, KEYS))


@query(f"""WITH {_NGAP}, v AS (SELECT * FROM ne WHERE frame IS NOT NULL AND ok), l AS (
        SELECT row_id, ordinal, frame, src_ip, dst_ip, coalesce(amf_ue_ngap_id, ran_ue_ngap_id) AS access, unnest(['amf_ue_ngap_id', 'ran_ue_ngap_id', 'pdu_session_id', 'suci', 'supi', 'guti']) AS kind, unnest([amf_ue_ngap_id, ran_ue_ngap_id, CAST(pdu_session_id AS VARCHAR), suci, supi, guti]) AS lookup_value FROM v)
    SELECT row_id, ordinal, kind, lookup_value, CASE WHEN kind IN ('suci', 'supi', 'guti') THEN 'UE' WHEN kind = 'pdu_session_id' THEN 'PDU_SESSION' ELSE 'ACCESS_CONTEXT' END AS node_type, CASE WHEN kind IN ('suci', 'supi', 'guti') THEN 'UE' WHEN kind = 'pdu_session_id' THEN 'SESSION' ELSE 'ACCESS_CONTEXT' END AS role,
        CASE WHEN kind IN ('suci', 'supi', 'guti') THEN kind || ':subscriber' WHEN kind = 'pdu_session_id' THEN kind || ':access:' || coalesce(access, 'unknown') ELSE kind || ':' || coalesce(src_ip, 'unknown') || ':' || coalesce(dst_ip, 'unknown') END AS scope_key
    FROM l WHERE lookup_value IS NOT NULL AND lookup_value <> ''""")
def ngap_observations(spark, d):
    """The identifiers of NGAP and NAS events in long form, with node type, role and scope."""
    e = C.ngap_events(read(spark, d, "ngap_messages"), REGISTRY, [*KEYS])
    o = C.observations_of(e.withColumn("k", F.struct("row_id", "ordinal")), ["k"])
    return o.filter(F.col("kind") != "procedure_transaction_id").select("k.row_id", "k.ordinal", "kind", "lookup_value", "node_type", "role", "scope_key")


@query("""SELECT protocol, part, validation_status, count(*) AS n FROM (
    SELECT protocol, part, validation_status FROM ({pfcp}) UNION ALL SELECT protocol, part, validation_status FROM ({ngap}) UNION ALL SELECT protocol, part, validation_status FROM ({http})) GROUP BY ALL""".format(pfcp=SQL["canonical_pfcp"], ngap=SQL["canonical_ngap"], http=SQL["canonical_http"]))
def partition_counts(spark, d):
    """How many events each partition has, by protocol and status; quarantined ones are in none."""
    return canonical_all(spark, d).groupBy("protocol", "part", "validation_status").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT DISTINCT event_id, observation_id, kind, lookup_value, scope_key FROM identity_observations WHERE event_id IS NOT NULL), n AS (SELECT kind, lookup_value, scope_key, min(observation_id) AS node_id FROM o GROUP BY ALL)
    SELECT o.event_id, count(DISTINCT node_id) AS n_nodes, min(node_id) AS first_node FROM o JOIN n ON o.kind = n.kind AND o.lookup_value IS NOT DISTINCT FROM n.lookup_value AND o.scope_key IS NOT DISTINCT FROM n.scope_key GROUP BY o.event_id""")
def event_nodes(spark, d):
    """The nodes of each event through its observations; a node is an identifier in its scope."""
    o = read(spark, d, "identity_observations").filter("event_id is not null").select("event_id", "observation_id", "kind", "lookup_value", "scope_key").distinct()
    node = o.groupBy("kind", "lookup_value", "scope_key").agg(F.min("observation_id").alias("node_id"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("kind", "lookup_value", "scope_key")]
    members = o.alias("o").join(node.alias("n"), same).select("observation_id", "node_id", I.node_type(F.col("o.kind")).alias("node_type"))
    n = I.nodes_of_events(o, o, members)
    return n.groupBy("event_id").agg(F.count_distinct("node_id").alias("n_nodes"), F.min("node_id").alias("first_node"))


@query("""WITH h AS (SELECT analysis_id, row_id, request.start_frame AS f, coalesce(nullif(transport.original_key, ''), 'own:' || row_id) AS k, response.status AS status, request.method AS method,
        nullif(regexp_extract(request.uri, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '') AS path, coalesce(completion.rst_stream, false) AS reset, coalesce(completion.capture_truncated, false) AS cut, completion.state AS state FROM http2_streams),
    t AS (SELECT analysis_id, k AS transaction_key, count(*) AS n_events, min(f) AS first_frame, arg_max(status, (f, row_id)) FILTER (status IS NOT NULL) AS status, arg_min(method, (f, row_id)) FILTER (method IS NOT NULL) AS method,
        bool_or(reset) AS reset, bool_or(cut) AS cut, min(state) AS state FROM h GROUP BY analysis_id, k),
    c AS (SELECT *, CASE WHEN reset THEN 'reset' WHEN cut THEN 'truncated' WHEN status IS NOT NULL AND method IS NOT NULL THEN 'complete' WHEN method IS NOT NULL THEN 'request_only' ELSE coalesce(state, 'unknown') END AS completion FROM t),
    g AS (SELECT *, CASE WHEN status >= 400 THEN 'http_status_failure' WHEN completion = 'complete' THEN NULL WHEN completion = 'reset' THEN 'http_reset' WHEN completion IN ('truncated', 'partial', 'incomplete_capture', 'response_only') THEN 'http_incomplete_capture'
        WHEN completion IN ('timeout', 'request_only', 'no_response') THEN 'http_timeout' ELSE 'http_incomplete_capture' END AS category FROM c)
    SELECT analysis_id, transaction_key, n_events, status, completion, category, CASE WHEN status >= 500 THEN 'critical' WHEN status >= 400 OR category = 'http_timeout' THEN 'error' ELSE 'warning' END AS severity FROM g WHERE category IS NOT NULL""")
def http_failures(spark, d):
    """Failed and incomplete HTTP transactions of the captures."""
    h = read(spark, d, "http2_streams")
    e = h.select(
        "analysis_id", F.col("row_id").alias("event_id"), F.col("request.start_frame").alias("frame"), F.col("response.status").alias("status"), F.col("request.method").alias("method"), url_path(F.col("request.uri")).alias("path"),
        F.col("completion.rst_stream").alias("reset"), F.col("completion.capture_truncated").alias("truncated"), F.col("completion.state").alias("state"), transaction_key(F.col("transport.original_key"), own=F.col("row_id")).alias("k"),
    )
    return failed_transactions(transactions(e, ["analysis_id"], F.col("k"))).select("analysis_id", "transaction_key", "n_events", "status", "completion", "category", "severity")


FIELDS = ["suci", "pdu_session_id", "ran_ue_ngap_id"]


@query(f"""WITH {_NGAP}, v AS (SELECT *, row_id * 2 + ordinal AS o FROM ne WHERE frame IS NOT NULL AND ok AND amf_ue_ngap_id IS NOT NULL), l AS (
        SELECT amf_ue_ngap_id, o, unnest(['suci', 'pdu_session_id', 'ran_ue_ngap_id']) AS field, unnest([suci, CAST(pdu_session_id AS VARCHAR), ran_ue_ngap_id]) AS value FROM v)
    SELECT amf_ue_ngap_id, field, arg_min(value, o) FILTER (value IS NOT NULL) AS value, count(DISTINCT value) AS n_values, CASE WHEN count(value) = 0 THEN 'missing' WHEN count(DISTINCT value) > 1 THEN 'conflict' ELSE 'decoded' END AS status FROM l GROUP BY 1, 2""")
def ue_request_fields(spark, d):
    """The fields of each access context's messages: the first value, conflicts and what is missing."""
    e = C.ngap_events(read(spark, d, "ngap_messages"), REGISTRY, KEYS).filter("validation_status != 'quarantined' and identifiers.amf_ue_ngap_id is not null")
    e = e.select(F.col("identifiers.amf_ue_ngap_id").alias("amf_ue_ngap_id"), *[F.nullif(F.col(f"identifiers.{f}").cast("string"), F.lit("")).alias(f) for f in FIELDS], (F.col("row_id") * 2 + F.col("ordinal")).alias("o"))
    return S.request_fields(e, ["amf_ue_ngap_id"], FIELDS, ["o"])


@query("""WITH l AS (SELECT left_observation_id AS observation_id, 'events' AS field, unnest(supporting_event_ids) AS value FROM identity_edges WHERE left_observation_id IS NOT NULL UNION ALL SELECT left_observation_id, 'rules', rule_id FROM identity_edges WHERE left_observation_id IS NOT NULL)
    SELECT DISTINCT observation_id, field, value FROM l WHERE value IS NOT NULL""")
def merged_evidence(spark, d):
    """The evidence of each observation over all its edges: events and rules."""
    e = read(spark, d, "identity_edges").filter("left_observation_id is not null").select(F.col("left_observation_id").alias("observation_id"), F.col("supporting_event_ids").alias("events"), F.array("rule_id").alias("rules"))
    return S.merged_sets(e, "observation_id", ["events", "rules"])


_FOUND = f"""f AS (SELECT analysis_id, 'HTTP2' AS protocol, category, severity, transaction_key AS k, CAST(NULL AS BIGINT) AS frame FROM ({SQL['http_failures']})
    UNION ALL SELECT analysis_id, 'PFCP', 'pfcp_failure', 'error', coalesce(response_to, seq, 'none') || ':' || coalesce(seid, 'none') || ':' || coalesce(node_pair, 'none'), first_frame FROM ({captures.SQL['pfcp_transactions']}) WHERE outcome = 'failure'
    UNION ALL SELECT analysis_id, 'NGAP', 'ngap_failure', 'error', CAST(c.row_id AS VARCHAR), c.frame FROM ({SQL['canonical_ngap']}) c JOIN ngap_messages m ON m.row_id = c.row_id WHERE c.protocol = 'NGAP' AND c.outcome = 'failure' AND c.validation_status <> 'quarantined')"""


@query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, frame NULLS LAST, protocol, k) AS place FROM f)
    SELECT analysis_id, protocol, category, severity, k, frame, place FROM r WHERE place <= 20""")
def failure_candidates(spark, d):
    """What three detectors found, put together, the 20 worst and earliest of each capture."""
    http = http_failures(spark, d).select("analysis_id", F.lit("HTTP2").alias("protocol"), "category", "severity", F.col("transaction_key").alias("k"), F.lit(None).cast("bigint").alias("frame"))
    none = lambda c: F.coalesce(c, F.lit("none"))
    key = F.concat_ws(":", F.coalesce("response_to", "seq", F.lit("none")), none("seid"), none("node_pair"))
    pfcp = captures.pfcp_transactions(spark, d).filter("outcome = 'failure'").select("analysis_id", F.lit("PFCP").alias("protocol"), F.lit("pfcp_failure").alias("category"), F.lit("error").alias("severity"), key.alias("k"), F.col("first_frame").alias("frame"))
    ngap = C.ngap_events(read(spark, d, "ngap_messages"), REGISTRY, KEYS).filter("protocol = 'NGAP' and outcome = 'failure' and validation_status != 'quarantined'")
    ngap = ngap.select("analysis_id", "protocol", F.lit("ngap_failure").alias("category"), F.lit("error").alias("severity"), F.col("row_id").cast("string").alias("k"), "frame")
    worst = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "error", 1).otherwise(2)
    both = http.unionByName(pfcp).unionByName(ngap)
    w = Window.partitionBy("analysis_id").orderBy(worst, F.col("frame").asc_nulls_last(), "protocol", "k")
    return both.withColumn("place", F.row_number().over(w)).filter("place <= 20")


@query("""WITH h AS (SELECT row_id, lower(nullif(regexp_extract(nullif(regexp_extract(request.uri, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), ''), '^/*([^/]+)', 1), '')) AS api, response.status AS status, request.headers AS hs FROM http2_streams)
    SELECT row_id, api, status, array_to_string(list_transform(list_filter(hs, lambda x: lower(x.name) NOT IN ('user-agent', 'accept', 'accept-encoding', 'content-length', 'date')), lambda x: lower(x.name)), ',') AS header_names
    FROM h WHERE coalesce(NOT (api IN ('nnrf-nfm', 'nnrf-disc', 'nudr-dr', 'nudr-group-id-map')), true) OR status >= 400""")
def lean_http(spark, d):
    """A view without routine streams of the registries (unless they failed) and without headers that say nothing."""
    return C.lean_streams(read(spark, d, "http2_streams"), [a for apis in PARTITIONS.values() for a in apis], DULL_HEADERS).select(
        "row_id", "api", F.col("response.status").alias("status"), F.array_join(F.transform("headers", lambda h: F.lower(h["name"])), ",").alias("header_names"),
    )


def _frames(spark, d):
    """The frames of the captured streams: one row per header, body segment and end; a stream and its row are the key."""
    h = read(spark, d, "http2_streams")
    none = F.lit(None)
    at = ["row_id", F.struct("transport.tcp_stream", "transport.http2_stream_id", F.col("transport.client.ip").alias("src"), F.col("transport.server.ip").alias("dst")).alias("t")]

    def rows(side: str):
        s = h.filter(F.col(side).isNotNull())
        head = s.select(*at, F.posexplode(f"{side}.headers").alias("part", "x")).select("row_id", "t", F.lit(side).alias("side"), F.col("x.frame").alias("frame"), "part", F.col("x.name").alias("name"), F.col("x.value").alias("value"), none.cast("string").alias("data"), F.lit(False).alias("end_stream"), F.lit(False).alias("reset"))
        body = s.select(*at, F.posexplode(f"{side}.body.segments").alias("part", "x")).select("row_id", "t", F.lit(side), F.col("x.frame"), F.col("part") + 1000, none.cast("string"), none.cast("string"), F.col("x.raw_hex"), F.lit(False), F.lit(False))
        ends = s.select(*at, F.col(f"completion.{side}_end_stream").alias("e"), F.col(f"{side}.end_frame").alias("f")).select("row_id", "t", F.lit(side), "f", F.lit(1 << 20), none.cast("string"), none.cast("string"), none.cast("string"), F.coalesce("e", F.lit(False)), F.lit(False))
        return head.unionAll(body).unionAll(ends)

    cut = h.filter("completion.rst_stream").select(*at, F.greatest("request.end_frame", "response.end_frame").alias("f")).select("row_id", "t", none.cast("string"), "f", F.lit(1 << 21), none.cast("string"), none.cast("string"), none.cast("string"), F.lit(False), F.lit(True))
    f = rows("request").unionAll(rows("response")).unionAll(cut).filter("frame is not null")
    k = stream_key(F.when(F.col("row_id") % 5 != 0, F.col("t.tcp_stream")), F.col("t.http2_stream_id"), F.col("t.src"), F.col("t.dst"))
    return f.withColumn("k", k).select("row_id", "k.key", "k.fallback", "side", "frame", "part", none.cast("decimal(28,9)").alias("time"), "name", "value", "data", "end_stream", "reset")


_SIDE = """SELECT row_id, '{s}' AS side, CAST(x.frame AS BIGINT) AS frame, CAST(part - 1 AS BIGINT) AS part, x.name AS name, x.value AS value, NULL AS data, false AS e, false AS r FROM (SELECT row_id, unnest({s}.headers) AS x, generate_subscripts({s}.headers, 1) AS part FROM http2_streams)
    UNION ALL SELECT row_id, '{s}', x.frame, part + 999, NULL, NULL, x.raw_hex, false, false FROM (SELECT row_id, unnest({s}.body.segments) AS x, generate_subscripts({s}.body.segments, 1) AS part FROM http2_streams)
    UNION ALL SELECT row_id, '{s}', {s}.end_frame, 1048576, NULL, NULL, NULL, coalesce(completion.{s}_end_stream, false), false FROM http2_streams WHERE {s} IS NOT NULL"""


@query(f"""WITH f AS ({_SIDE.format(s='request')} UNION ALL {_SIDE.format(s='response')} UNION ALL SELECT row_id, NULL, greatest(request.end_frame, response.end_frame), 2097152, NULL, NULL, NULL, false, true FROM http2_streams WHERE completion.rst_stream),
    k AS (SELECT f.*, CASE WHEN f.row_id % 5 <> 0 AND transport.tcp_stream IS NOT NULL THEN concat_ws(':', transport.tcp_stream, transport.http2_stream_id) ELSE concat_ws('|', least(transport.client.ip, transport.server.ip), greatest(transport.client.ip, transport.server.ip), transport.http2_stream_id) END AS key,
        NOT (f.row_id % 5 <> 0 AND transport.tcp_stream IS NOT NULL) AS fallback FROM f JOIN http2_streams h ON h.row_id = f.row_id WHERE f.frame IS NOT NULL),
    o AS (SELECT *, coalesce(bool_or(r OR (side = 'request' AND e)) OVER w, false) AS q, coalesce(bool_or(r) OVER w, false) OR (coalesce(bool_or(e AND side = 'request') OVER w, false) AND coalesce(bool_or(e AND side = 'response') OVER w, false)) AS done FROM k
        WINDOW w AS (PARTITION BY row_id, key ORDER BY frame, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT row_id, key, CAST(done AS INTEGER) AS generation, min(frame) FILTER (side = 'request') AS request_first_frame, max(frame) FILTER (side = 'response') AS response_last_frame, count(name) FILTER (side = 'request') AS n_request_headers,
        coalesce(string_agg(data, '' ORDER BY frame, part) FILTER (side = 'request' AND data IS NOT NULL), '') AS rh, coalesce(string_agg(data, '' ORDER BY frame, part) FILTER (side = 'response' AND data IS NOT NULL), '') AS sh,
        arg_min(value, (frame, part)) FILTER (side = 'request' AND lower(name) = ':method') AS method, TRY_CAST(arg_min(value, (frame, part)) FILTER (side = 'response' AND lower(name) = ':status') AS INTEGER) AS status, bool_or(r) AS reset,
        coalesce(bool_or(e AND side = 'request'), false) AND coalesce(bool_or(e AND side = 'response'), false) AS both_ended, min(frame) FILTER (side = 'response') AS sf, bool_or(fallback) AS fallback FROM o GROUP BY ALL)
    SELECT row_id, key, generation, request_first_frame, response_last_frame, n_request_headers, length(rh) // 2 AS request_bytes, sha256(unhex(sh)) AS response_sha256, method, status,
        CASE WHEN reset THEN 'reset' WHEN both_ended THEN 'complete' WHEN sf IS NULL AND request_first_frame IS NOT NULL THEN 'request_only' WHEN request_first_frame IS NULL AND sf IS NOT NULL THEN 'response_only' WHEN request_first_frame IS NULL THEN 'unknown' ELSE 'partial' END AS completion,
        array_to_string(list_filter([CASE WHEN fallback THEN 'fallback_key' END, CASE WHEN n_request_headers = 0 AND request_first_frame IS NOT NULL THEN 'no_request_headers' END, CASE WHEN status IS NULL AND sf IS NOT NULL THEN 'no_status' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM g""")
def stream_reassembly(spark, d):
    """Streams from their frames: headers, bodies, completion and warnings."""
    s = reassemble(_frames(spark, d), ["row_id", "key"])
    return s.select("row_id", "key", "generation", "request_first_frame", "response_last_frame", F.size("request_headers").cast("bigint").alias("n_request_headers"), "request_bytes", "response_sha256", "method", "status", "completion", F.array_join("warnings", ",").alias("warnings"))
