"""Decoded records as canonical events: one row per message, with identifiers, outcome, partition and what is wrong with it.

Narrow projections only: each tree is walked once, in one Arrow UDF, and nothing
is shuffled. No record is dropped: those that can't be an event are kept with
``validation_status`` quarantined.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrace.functions import messages as M
from sigtrace.functions import text as X
from sigtrace.functions.http import target
from sigtrace.functions.ids import uuid5
from sigtrace.functions.numbers import number_text
from sigtrace.operators import identity as I

SPACE = uuid.UUID("4d0b8a52-5c7e-5b1e-9b63-0f7a1c2e9d44")
# The kinds of identifiers of an event.
STRING_IDS = ["supi", "suci", "gpsi", "guti", "pei", "amf_ue_ngap_id", "ran_ue_ngap_id", "sm_context_ref", "http2_key", "correlation_id", "charging_id", "cp_seid", "up_seid", "ue_ip"]
NUMBER_IDS = ["pdu_session_id", "procedure_transaction_id", "pfcp_sequence"]
ACCESS_SUFFIXES = {"amf_ue_ngap_id": ["amfuengapid", "amf-ue-ngap-id"], "ran_ue_ngap_id": ["ranuengapid", "ran-ue-ngap-id"]}
SESSION_SUFFIXES = ["pdusessionid", "pdu-session-id"]
NAS_SUFFIXES = {"suci": ["suci"], "supi": ["supi"], "gpsi": ["gpsi"], "guti": ["guti"], "pei": ["pei", "imei", "imeisv"]}
PFCP_SUFFIXES = {"cp_seid": ["cpseid", "cp-f-seid", "f-seid"], "up_seid": ["upseid", "up-f-seid"], "ue_ip": ["ueip", "ue-ip-address"], "charging_id": ["chargingid", "charging-id"]}


@dataclass(frozen=True)
class Registry:
    """Names of codes, the APIs of each partition, and prefixes of APIs that a partition should list."""

    ngap: dict[str, str] = field(default_factory=dict)
    nas: dict[str, str] = field(default_factory=dict)
    pfcp: dict[str, str] = field(default_factory=dict)
    partitions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    prefixes: tuple[str, ...] = ()


def route(protocol: Column, api: Column, registry: Registry) -> Column:
    """``part, reason, confidence, issue`` of an event: signalling and listed APIs with high confidence, an API that only
    looks like one of a partition with low confidence and an issue, all else primary with medium confidence."""
    row = lambda part, reason, confidence, issue=None: F.struct(F.lit(part).alias("part"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"), F.lit(issue).cast("string").alias("issue"))
    c = F.when(protocol.isin("NAS", "NGAP", "PFCP"), row("primary", "signalling", "high"))
    for name, apis in registry.partitions.items():
        c = c.when(F.lower(api).isin(*apis), row(name, "listed_api", "high"))
    for p in registry.prefixes:
        c = c.when(F.lower(api).startswith(p), row("primary", "unlisted_api", "low", "unlisted_api"))
    return c.otherwise(row("primary", "default", "medium"))


def _named(code: Column, names: dict[str, str], prefix: str, missing: str) -> tuple[Column, Column]:
    """A code's name, and the issue of a code without."""
    name = F.coalesce(X.named_code(code, names, prefix), F.lit(missing))
    return name, F.when(code.isNotNull() & ~F.coalesce(code.isin(*names), F.lit(False)), F.lit(f"unknown_{prefix.lower()}_code"))


def _identifiers(found: dict[str, Column]) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    ids = [(F.nullif(found[k].cast("string"), F.lit("")) if k in found else none("string")).alias(k) for k in STRING_IDS]
    return F.struct(*ids, *[(found[k].cast("bigint") if k in found else none("bigint")).alias(k) for k in NUMBER_IDS])


def _event(source: str, ordinal: int, protocol: str, message: Column, procedure: Column, outcome: Column, direction: str, ids: dict[str, Column], cause: Column, code: Column, issues: list[Column], bad: list[tuple[Column, str]]) -> Column:
    """The part of an event that depends on its protocol, as a struct."""
    wrong = [F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in bad]
    return F.struct(
        F.lit(source).alias("source"), F.lit(ordinal).alias("ordinal"), F.lit(protocol).alias("protocol"), message.alias("message_type"), procedure.alias("procedure"), outcome.alias("outcome"), F.lit(direction).alias("direction"),
        _identifiers(ids).alias("identifiers"), cause.cast("string").alias("cause"), code.cast("string").alias("raw_code"), F.array_compact(F.array(*issues, F.lit(None).cast("string"))).alias("issues"), F.array_compact(F.array(*wrong, F.lit(None).cast("string"))).alias("quarantine"),
    )


def finish(rows: DataFrame, registry: Registry, api: Column, keys: list[str]) -> DataFrame:
    """Route events and stamp them: ``rows`` have ``keys``, ``frame``, ``time_epoch``, endpoints and the struct ``e``."""
    r = rows.select("*", route(F.col("e.protocol"), api, registry).alias("_r"))
    issues = F.array_compact(F.concat("e.issues", F.array(F.col("_r.issue"))))
    status = F.when(F.size("e.quarantine") > 0, "quarantined").when(F.size(issues) > 0, "partial").otherwise("valid")
    return r.select(
        *keys, uuid5(SPACE, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col("e.source"), F.col("e.ordinal")).alias("event_id"),
        "e.source", "e.ordinal", "e.protocol", F.col("frame").cast("bigint").alias("frame"), X.decimal_seconds(F.col("time_epoch")).alias("seconds"), X.time_precision(F.col("time_epoch")).alias("time_precision"),
        "src_ip", "src_port", "dst_ip", "dst_port", "e.direction", "e.message_type", "e.procedure", "e.outcome", "e.cause", "e.raw_code", "e.identifiers",
        F.when(status != "quarantined", F.col("_r.part")).alias("part"), F.col("_r.reason").alias("part_reason"), F.col("_r.confidence").alias("part_confidence"), status.alias("validation_status"), F.concat("e.quarantine", issues).alias("issues"),
    )


def _ends() -> list[Column]:
    return [F.col(f"transport.{c}").alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")]


def ngap_events(df: DataFrame, registry: Registry, keys: list[str]) -> DataFrame:
    """NGAP messages, each with the NAS message inside it (if any) as a second event that inherits its identifiers.

    A NAS message whose type can't be seen is an event with an issue. Records
    without frame or with a tree that is no object or array are quarantined.
    """
    wanted = ACCESS_SUFFIXES | {"pdu_session_id": SESSION_SUFFIXES, "code": ["procedurecode"], "cause": ["cause"]}
    of_nas = NAS_SUFFIXES | {"pdu_session_id": SESSION_SUFFIXES, "pti": ["pti", "proceduretransactionidentity"], "code": ["message_type", "mmmessage", "gsmmessage"], "cause": ["cause", "rejectcause"]}
    d = df.select(*keys, "frame", "time_epoch", *_ends(), F.col("ngap").alias("_t"), F.col("nas").isNotNull().alias("_has"), X.first_values(F.col("ngap"), wanted, "kind").alias("g"), X.first_values(F.col("nas"), of_nas, "kind").alias("n"))
    access = {k: F.col(f"g.{k}") for k in ACCESS_SUFFIXES}
    session = M.first_int(F.col("g.pdu_session_id"))
    name, unknown = _named(F.col("g.code"), registry.ngap, "NGAP", "NGAP_PDU")
    no_frame = (F.col("frame").isNull(), "no_frame")
    outer = _event("ngap_message", 0, "NGAP", name, name, M.pdu_outcome(M.pdu_class(F.col("_t"))), "UNKNOWN", access | {"pdu_session_id": session}, F.col("g.cause"), F.col("g.code"), [unknown], [no_frame, (F.col("g.kind").isNull(), "unreadable_tree")])
    nas, unknown_nas = _named(F.col("n.code"), registry.nas, "NAS", "NAS_PDU")
    hidden = F.when(F.col("n.code").isNull(), "type_not_visible")
    ids = access | {k: F.col(f"n.{k}") for k in NAS_SUFFIXES} | {"pdu_session_id": F.coalesce(session, M.first_int(F.col("n.pdu_session_id"))), "procedure_transaction_id": M.first_int(F.col("n.pti"))}
    inner = _event("nas_embedded", 1, "NAS", nas, nas, F.lit("unknown"), "UNKNOWN", ids, F.col("n.cause"), F.col("n.code"), [unknown_nas, hidden], [no_frame, (F.col("g.kind").isNull(), "unreadable_tree")])
    rows = d.select(*keys, "frame", "time_epoch", "src_ip", "src_port", "dst_ip", "dst_port", F.explode(F.filter(F.array(outer, F.when(F.col("_has"), inner)), lambda x: x.isNotNull())).alias("e"))
    return finish(rows, registry, F.lit(None).cast("string"), keys)


def pfcp_events(df: DataFrame, registry: Registry, keys: list[str], heartbeats: bool = True) -> DataFrame:
    """PFCP messages; without ``heartbeats`` routine ones are left out."""
    d = df.select(*keys, "frame", "time_epoch", *_ends(), "msg_type", "seq_num", "response_to", "response_in", F.coalesce("is_heartbeat", F.lit(False)).alias("_routine"), F.col("pfcp").alias("_t"), X.first_values(F.col("pfcp"), PFCP_SUFFIXES | {"pdu_session_id": SESSION_SUFFIXES, "cause": ["cause"]}, "kind").alias("p"))
    d = d if heartbeats else d.filter(~F.col("_routine"))
    code = number_text(F.col("msg_type"))
    name, unknown = _named(code, registry.pfcp, "PFCP", "PFCP_MESSAGE")
    ids = {k: F.col(f"p.{k}") for k in PFCP_SUFFIXES} | {"pdu_session_id": M.first_int(F.col("p.pdu_session_id")), "pfcp_sequence": M.first_int(F.col("seq_num"))}
    answered = lambda c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("None"))
    e = _event("pfcp_message", 0, "PFCP", name, name, M.reply_outcome(answered("response_to"), answered("response_in"), F.col("_t")), "NF_TO_NF", ids, F.col("p.cause"), code, [unknown], [(F.col("frame").isNull(), "no_frame"), (F.col("p.kind").isNull(), "unreadable_tree")])
    return finish(d.select(*keys, "frame", "time_epoch", "src_ip", "src_port", "dst_ip", "dst_port", e.alias("e")), registry, F.lit(None).cast("string"), keys)


def http_events(df: DataFrame, registry: Registry, keys: list[str]) -> DataFrame:
    """HTTP/2 streams as one event each, from the request or, without one, the response."""
    headers = F.concat(F.coalesce("request.headers", F.array().cast("array<struct<name:string,value:string,frame:bigint>>")), F.coalesce("response.headers", F.array().cast("array<struct<name:string,value:string,frame:bigint>>")))
    method = F.coalesce("request.method", X.header(F.col("request.headers"), ":method"))
    d = df.select(
        *keys, F.coalesce("request.start_frame", "response.start_frame").alias("frame"), F.coalesce("request.start_time_epoch", "response.start_time_epoch").alias("time_epoch"),
        F.col("transport.client.ip").alias("src_ip"), F.col("transport.client.port").alias("src_port"), F.col("transport.server.ip").alias("dst_ip"), F.col("transport.server.port").alias("dst_port"),
        method.alias("_method"), F.coalesce("request.uri", target(F.col("request.headers"))).alias("_uri"), headers.alias("_h"), F.col("transport.original_key").alias("_key"), F.col("response.status").alias("_status"), (F.col("completion.state") == "response_only").alias("_only"),
    )
    path = X.url_path(F.col("_uri"))
    api = X.first_segment(path)
    name = F.concat_ws(" ", F.coalesce("_method", F.lit("HTTP2")), F.coalesce(path, F.col("_uri"), F.lit("HTTP2_STREAM")))
    ids = {"http2_key": F.col("_key"), "correlation_id": X.header(F.col("_h"), "3gpp-sbi-correlation-info", "x-correlation-id"), "sm_context_ref": X.after_segment(path, "sm-contexts"), "charging_id": X.header(F.col("_h"), "x-charging-id")}
    e = _event("http2_stream", 0, "HTTP2", name, api, X.status_class(F.col("_status"), F.col("_only")), "NF_TO_NF", ids, F.lit(None), F.col("_status"), [], [(F.col("frame").isNull(), "no_frame")])
    return finish(d.select("*", e.alias("e"), api.alias("_api")), registry, F.col("_api"), keys)


def observations_of(events: DataFrame, keys: list[str]) -> DataFrame:
    """Identifiers of events in long form: ``keys, event_id, frame, seconds, kind, lookup_value, node_type, role, scope_key``.

    Quarantined events and other partitions than the primary one have none.
    """
    kinds = [*STRING_IDS, *NUMBER_IDS]
    use = events.filter("part = 'primary'").select(*keys, "event_id", "frame", "seconds", "src_ip", "dst_ip", *[F.col(f"identifiers.{k}").alias(k) for k in kinds], F.coalesce("identifiers.amf_ue_ngap_id", "identifiers.ran_ue_ngap_id").alias("_access"))
    long = I.to_long(use, [*keys, "event_id", "frame", "seconds", "src_ip", "dst_ip", "_access"], kinds)
    k = F.col("kind")
    return long.select(*keys, "event_id", "frame", "seconds", "kind", "lookup_value", I.node_type(k).alias("node_type"), I.role(k).alias("role"), I.scope_key(k, F.col("_access"), F.col("src_ip"), F.col("dst_ip"), F.col("frame")).alias("scope_key"))


def lean_streams(streams: DataFrame, routine: list[str], dull: list[str]) -> DataFrame:
    """HTTP/2 streams with their ``api`` and request ``headers``: those of ``routine`` APIs only if they failed, ``dull`` headers left out."""
    s = streams.withColumn("api", F.lower(X.first_segment(X.url_path(F.col("request.uri")))))
    keep = F.coalesce(~F.col("api").isin(routine), F.lit(True)) | F.coalesce(F.col("response.status") >= 400, F.lit(False))
    return s.filter(keep).withColumn("headers", F.filter("request.headers", lambda h: ~F.coalesce(F.lower(h["name"]).isin(dull), F.lit(False))))
