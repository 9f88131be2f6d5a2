from pyspark.sql import functions as F

from sigtrace.operators.reassembly import reassemble, stream_key

SCHEMA = "k string, side string, frame long, part int, time decimal(28,9), name string, value string, data string, end_stream boolean, reset boolean, fallback boolean"


def row(k, side, frame, name=None, value=None, data=None, end=False, reset=False, fallback=False, part=0):
    return (k, side, frame, part, None, name, value, data, end, reset, fallback)


def test_streams_from_frames(spark):
    rows = [
        row("a", "request", 1, ":method", "GET"), row("a", "request", 1, ":path", "/x", part=1), row("a", "request", 2, data="ab", end=True), row("a", "response", 4, data="02"), row("a", "response", 3, ":status", "200"), row("a", "response", 3, data="01", part=1), row("a", "response", 5, end=True),
        row("a", "request", 6, ":method", "PUT"), row("b", "request", 1, data="ff"), row("b", None, 2, reset=True), row("b", "response", 3, ":status", "500"), row("c", "response", 9, data="00", fallback=True),
    ]
    got = {(r.k, r.generation): r for r in reassemble(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)]
    a = got["a", 0]
    assert (a.method, a.path, a.status, a.completion, a.request_hex, a.response_hex, a.request_bytes, a.response_last_frame, a.warnings) == ("GET", "/x", 200, "complete", "ab", "0102", 1, 5, [])
    assert [h.name for h in a.request_headers] == [":method", ":path"]
    assert got["a", 1].completion == "request_only" and got["b", 0].completion == "reset" and got["b", 0].warnings == ["no_request_headers"] and got["b", 1].completion == "response_only"
    assert got["c", 0].warnings == ["fallback_key", "no_status"]
    assert reassemble(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0


def test_keys_of_both_directions(spark):
    df = spark.createDataFrame([("7", 1, "x", "y"), (None, 1, "x", "y"), (None, 1, "y", "x"), (None, None, None, "x")], "c string, s int, a string, b string")
    got = [tuple(r[0]) for r in df.select(stream_key(F.col("c"), F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert got == [("7:1", False), ("x|y|1", True), ("x|y|1", True), ("x|x", True)]
