"""HTTP/2 streams put together from captured frames: headers, bodies, completion, warnings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.functions.text import header


def stream_key(connection: Column, stream: Column, src: Column, dst: Column) -> Column:
    """``key`` and ``fallback``: connection and stream number, or without a connection the two addresses (in one order for
    both directions) and the stream number."""
    plain = F.concat_ws(":", connection.cast("string"), stream.cast("string"))
    ends = F.concat_ws("|", F.least(src, dst), F.greatest(src, dst), stream.cast("string"))
    return F.struct(F.when(connection.isNotNull(), plain).otherwise(ends).alias("key"), connection.isNull().alias("fallback"))


def with_generation(frames: DataFrame, keys: list[str]) -> DataFrame:
    """``generation``: how many streams of the key were complete before each frame.

    A stream is complete as soon as both sides have ended or it was reset; what
    comes later on its key is a new one. A key's frames stream through one task
    with two flags and a number as its state.
    """
    ordered = frames.repartition(*keys).sortWithinPartitions(*keys, "frame", "part")
    schema = T.StructType([*ordered.schema.fields, T.StructField("generation", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, ended = None, 0, set()
        for f in batches:
            out = []
            owners = zip(*[f[c] for c in keys])
            for owner, side, end, reset in zip(owners, f["side"], f["end_stream"], f["reset"]):
                if owner != now:
                    now, n, ended = owner, 0, set()
                out.append(n)
                if end is True or end == 1:
                    ended.add(side)
                if reset is True or reset == 1 or len(ended) == 2:
                    n, ended = n + 1, set()
            f["generation"] = pd.Series(out, index=f.index, dtype="int32")
            yield f

    return ordered.mapInPandas(run, schema)


def reassemble(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row per stream of frames with ``side`` (request or response), ``frame``, ``part`` (order within a frame),
    ``time``, ``name`` and ``value`` of a header or ``data`` (hex) of a body, ``end_stream``, ``reset``, ``fallback``.

    Per side: first and last frame and time, headers in order, body bytes with
    digest; method, path and status from the headers; the completion; warnings
    (``fallback_key``, ``no_request_headers``, ``no_status``). Frames without a
    side count for the reset alone. A stream is one row, so it is put together
    in one task.
    """
    f = with_generation(frames, keys)

    def side(s: str) -> list[Column]:
        mine = F.col("side") == s
        heads = F.sort_array(F.collect_list(F.when(mine & F.col("name").isNotNull(), F.struct("frame", "part", "name", "value"))))
        data = F.sort_array(F.collect_list(F.when(mine & F.col("data").isNotNull(), F.struct("frame", "part", "data"))))
        pick = lambda fn, c: fn(F.when(mine, F.col(c)))
        return [
            pick(F.min, "frame").alias(f"{s}_first_frame"), pick(F.max, "frame").alias(f"{s}_last_frame"), pick(F.min, "time").alias(f"{s}_first_time"), pick(F.max, "time").alias(f"{s}_last_time"),
            F.transform(heads, lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value"), h["frame"].alias("frame"))).alias(f"{s}_headers"),
            F.array_join(F.transform(data, lambda p: p["data"]), "").alias(f"{s}_hex"), F.coalesce(F.bool_or(mine & F.col("end_stream")), F.lit(False)).alias(f"{s}_ended"),
        ]

    g = f.groupBy(*keys, "generation").agg(*side("request"), *side("response"), F.coalesce(F.bool_or("reset"), F.lit(False)).alias("reset"), F.coalesce(F.bool_or("fallback"), F.lit(False)).alias("_fallback"))
    done = (
        F.when(F.col("reset"), "reset").when(F.col("request_ended") & F.col("response_ended"), "complete").when(F.col("response_first_frame").isNull() & F.col("request_first_frame").isNotNull(), "request_only")
        .when(F.col("request_first_frame").isNull() & F.col("response_first_frame").isNotNull(), "response_only").when(F.col("request_first_frame").isNull(), "unknown").otherwise("partial")
    )
    for s in ("request", "response"):
        g = g.withColumn(f"{s}_bytes", (F.length(f"{s}_hex") / 2).cast("bigint")).withColumn(f"{s}_sha256", F.sha2(F.unhex(f"{s}_hex"), 256))
    g = g.withColumns({"method": header(F.col("request_headers"), ":method"), "path": header(F.col("request_headers"), ":path"), "status": header(F.col("response_headers"), ":status").try_cast("int"), "completion": done})
    warn = [F.when(F.col("_fallback"), "fallback_key"), F.when((F.size("request_headers") == 0) & F.col("request_first_frame").isNotNull(), "no_request_headers"), F.when(F.col("status").isNull() & F.col("response_first_frame").isNotNull(), "no_status")]
    return g.withColumn("warnings", F.array_compact(F.array(*warn))).drop("_fallback")
