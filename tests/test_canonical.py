from pyspark.sql import functions as F

from sigtrace.operators import canonical as C

TRANSPORT = "struct<src_ip:string,dst_ip:string,src_port:int,dst_port:int>"
REG = C.Registry({"14": "INITIAL_CONTEXT_SETUP"}, {"65": "REGISTRATION_REQUEST"}, {"50": "SESSION_ESTABLISHMENT_REQUEST"}, {"udr": ("nudr-dr",), "nrf": ("nnrf-nfm",)}, ("nnrf", "nudr"))


def test_ngap_with_nas(spark):
    rows = [
        (1, 20, "2.000001", '{"initiatingMessage":{"procedureCode":"14","x":[{"AMF-UE-NGAP-ID":["100"]},{"RAN-UE-NGAP-ID":"200"},{"pDUSessionID":"0x7"}]}}', '{"message_type":"65","suci":"suci-001"}'),
        (2, 21, "3", '[{"unsuccessfulOutcome":{"procedureCode":"99"}}]', '{"suci":"s"}'), (3, None, None, '{"a":1}', None), (4, 22, "x", '{"cut', None), (5, 23, "1.5", None, '{"message_type":"7"}'),
    ]
    df = spark.createDataFrame(rows, "row_id long, frame long, time_epoch string, ngap string, nas string").withColumn("transport", F.lit(None).cast(TRANSPORT)).withColumn("extra", F.lit(1))
    got = {(r.row_id, r.ordinal): r for r in C.ngap_events(df, REG, ["row_id"]).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0), (5, 1)]
    a, b = got[1, 0], got[1, 1]
    assert (a.message_type, a.outcome, a.validation_status, a.part, a.time_precision) == ("INITIAL_CONTEXT_SETUP", "request", "valid", "primary", "microseconds")
    assert (a.identifiers.amf_ue_ngap_id, a.identifiers.ran_ue_ngap_id, a.identifiers.pdu_session_id, a.identifiers.suci) == ("100", "200", 7, None)
    assert (b.protocol, b.message_type, b.identifiers.suci, b.identifiers.amf_ue_ngap_id, b.identifiers.pdu_session_id) == ("NAS", "REGISTRATION_REQUEST", "suci-001", "100", 7)
    assert got[2, 0].outcome == "failure" and got[2, 0].message_type == "NGAP_UNKNOWN_99" and got[2, 0].issues == ["unknown_ngap_code"] and got[2, 0].validation_status == "partial"
    assert got[2, 1].message_type == "NAS_PDU" and got[2, 1].issues == ["type_not_visible"]
    for k, why in (((3, 0), "no_frame"), ((4, 0), "unreadable_tree"), ((5, 1), "unreadable_tree")):
        assert got[k].validation_status == "quarantined" and got[k].part is None and why in got[k].issues
    assert len({r.event_id for r in got.values()}) == 8
    assert C.ngap_events(df.limit(0), REG, ["row_id"]).count() == 0


def test_pfcp_and_http(spark):
    rows = [(1, 30, "50", "9", False, None, "31", '{"cpseid":"0x1","ueip":"198.51.100.10","pdu_session_id":"7"}'), (2, 31, "51", "x", True, "30", None, '{"cause":"rejected"}')]
    df = spark.createDataFrame(rows, "row_id long, frame long, msg_type string, seq_num string, is_heartbeat boolean, response_to string, response_in string, pfcp string").withColumn("time_epoch", F.lit("1.0")).withColumn("transport", F.lit(None).cast(TRANSPORT))
    got = {r.row_id: r for r in C.pfcp_events(df, REG, ["row_id"]).collect()}
    assert (got[1].message_type, got[1].outcome, got[1].identifiers.cp_seid, got[1].identifiers.ue_ip, got[1].identifiers.pdu_session_id, got[1].identifiers.pfcp_sequence) == ("SESSION_ESTABLISHMENT_REQUEST", "request", "0x1", "198.51.100.10", 7, 9)
    assert got[2].outcome == "failure" and got[2].message_type == "PFCP_UNKNOWN_51" and got[2].cause == "rejected" and got[2].identifiers.pfcp_sequence is None
    assert C.pfcp_events(df, REG, ["row_id"], heartbeats=False).count() == 1
    side = "struct<start_frame:bigint,start_time_epoch:string,headers:array<struct<name:string,value:string,frame:bigint>>,method:string,uri:string,status:int>"
    http = spark.sql(f"""SELECT id AS row_id, from_json(q, '{side}') AS request, from_json(r, '{side}') AS response, named_struct('client', named_struct('ip', 'c', 'port', 1), 'server', named_struct('ip', 's', 'port', 2), 'original_key', '1:1') AS transport, named_struct('state', st) AS completion FROM VALUES
        (1L, '{{"start_frame":10,"start_time_epoch":"2","method":"GET","uri":"http://h/nudr-dr/v1/sm-contexts/ab?x=1"}}', '{{"start_frame":11,"status":200,"headers":[{{"name":"X-Correlation-ID","value":"cc"}}]}}', 'complete'), (2L, NULL, '{{"start_frame":12,"status":503}}', 'response_only'),
        (3L, '{{"start_frame":13,"headers":[{{"name":":method","value":"PUT"}},{{"name":":path","value":"/nnrf-xyz/a"}}]}}', NULL, 'request_only'), (4L, NULL, NULL, NULL) t(id, q, r, st)""")
    got = {r.row_id: r for r in C.http_events(http, REG, ["row_id"]).collect()}
    assert (got[1].message_type, got[1].procedure, got[1].outcome, got[1].part, got[1].part_confidence) == ("GET /nudr-dr/v1/sm-contexts/ab", "nudr-dr", "success", "udr", "high")
    assert got[1].identifiers.sm_context_ref == "ab" and got[1].identifiers.correlation_id == "cc" and got[1].identifiers.http2_key == "1:1"
    assert got[2].outcome == "unknown" and got[2].message_type == "HTTP2 HTTP2_STREAM" and got[3].message_type == "PUT /nnrf-xyz/a" and got[3].issues == ["unlisted_api"] and got[3].part_confidence == "low"
    assert got[4].validation_status == "quarantined"
    o = C.observations_of(C.http_events(http, REG, ["row_id"]), ["row_id"])
    assert {r.kind for r in o.collect()} == {"http2_key"}  # the others are not in the primary partition
