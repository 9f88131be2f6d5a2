"""Requests and responses grouped into transactions, and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(value: Column, *order: Column) -> Column:
    """The value of the row last by ``order`` among those with a value; an aggregate."""
    return F.max(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))["v"]


def earliest(value: Column, *order: Column) -> Column:
    return F.min(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))["v"]


def transactions(events: DataFrame, keys: list[str], group: Column) -> DataFrame:
    """One row per transaction of events with ``frame``, ``event_id``, ``status``, ``method``, ``path``, ``reset``, ``truncated``, ``state``.

    The status is that of the latest event with one; reset wins over truncated,
    complete (status and method known), request_only (method alone), then the
    least state. Partial aggregation only, no event list is kept.
    """
    at = (F.col("frame"), F.col("event_id"))
    g = events.groupBy(*keys, group.alias("transaction_key")).agg(
        F.count("*").alias("n_events"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        latest(F.col("status"), *at).alias("status"),
        earliest(F.col("method"), *at).alias("method"),
        earliest(F.col("path"), *at).alias("path"),
        F.coalesce(F.bool_or("reset"), F.lit(False)).alias("_reset"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("_cut"),
        F.min("state").alias("_state"),
    )
    completion = (
        F.when(F.col("_reset"), "reset")
        .when(F.col("_cut"), "truncated")
        .when(F.col("status").isNotNull() & F.col("method").isNotNull(), "complete")
        .when(F.col("method").isNotNull(), "request_only")
        .otherwise(F.coalesce("_state", F.lit("unknown")))
    )
    return g.withColumn("completion", completion).drop("_reset", "_cut", "_state")


def retry_groups(tx: DataFrame, by: list[str], failed: Column, order: list[str]) -> DataFrame:
    """Groups of at least two transactions of which one before the last (by ``order``) failed; one aggregate."""
    bad = F.coalesce(failed, F.lit(False))
    last = F.max_by(bad.cast("int"), F.struct(*order))
    g = tx.groupBy(*by).agg(F.count("*").alias("n_transactions"), (F.count_if(bad) - last).alias("failed_before_last"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))
    return g.filter("n_transactions >= 2 and failed_before_last >= 1")


def assemble_streams(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Streams put together from frames (``side``, ``frame``, ``time``, ``data`` hex, ``end_stream``, ``reset``).

    Per side the first and last frame and time, the bytes in the order of frames
    and their digest; the completion follows from the flags. A stream's bytes
    are one value, so one stream is put together in one task.
    """
    def side(name: str) -> list[Column]:
        mine = F.col("side") == name
        parts = F.sort_array(F.collect_list(F.when(mine & F.col("data").isNotNull(), F.struct("frame", "data"))))
        return [
            F.min(F.when(mine, F.col("frame"))).alias(f"{name}_first_frame"),
            F.max(F.when(mine, F.col("frame"))).alias(f"{name}_last_frame"),
            F.min(F.when(mine, F.col("time"))).alias(f"{name}_first_time"),
            F.max(F.when(mine, F.col("time"))).alias(f"{name}_last_time"),
            F.array_join(F.transform(parts, lambda p: p["data"]), "").alias(f"{name}_hex"),
            F.coalesce(F.bool_or(mine & F.col("end_stream")), F.lit(False)).alias(f"{name}_ended"),
        ]

    g = frames.groupBy(*keys).agg(*side("request"), *side("response"), F.coalesce(F.bool_or("reset"), F.lit(False)).alias("reset"))
    done = (
        F.when(F.col("reset"), "reset")
        .when(F.col("request_ended") & F.col("response_ended"), "complete")
        .when(F.col("response_first_frame").isNull(), "request_only")
        .when(F.col("request_first_frame").isNull(), "response_only")
        .otherwise("partial")
    )
    for s in ("request", "response"):
        g = g.withColumn(f"{s}_bytes", (F.length(f"{s}_hex") / 2).cast("bigint")).withColumn(f"{s}_sha256", F.sha2(F.unhex(f"{s}_hex"), 256))
    return g.withColumn("completion", done)


def state_of(flags: dict[str, Column]) -> Column:
    """The worst of a lattice of states, in the order given: the first whose flag is true; else success."""
    c = None
    for name, flag in flags.items():
        c = F.when(flag, name) if c is None else c.when(flag, name)
    return c.otherwise("success") if c is not None else F.lit("success")


def first_per_code(df: DataFrame, code: str, order: list[str], n: int) -> DataFrame:
    """Up to ``n`` sample rows per code, first by ``order``."""
    w = Window.partitionBy(code).orderBy(*order)
    return df.withColumn("sample_no", F.row_number().over(w)).filter(F.col("sample_no") <= n)


def transaction_key(*parts: Column, own: Column) -> Column:
    """The first of the keys that is neither null nor empty, else ``own``, so that an event without any is a transaction of its own."""
    return F.coalesce(*[F.nullif(p.cast("string"), F.lit("")) for p in parts], F.concat(F.lit("own:"), own.cast("string")))


def http_failures(tx: DataFrame, ended: Column | None = None) -> DataFrame:
    """Failed and incomplete transactions: ``category`` and ``severity``; complete ones without a failing status have no row.

    A status from 400 on is a status failure (critical from 500 on); else what is
    not complete was reset, cut off by the capture, or without an answer (a
    timeout, also where ``ended`` says that the attempt around it timed out).
    """
    status, done = F.col("status"), F.col("completion")
    timed_out = F.coalesce(ended.isin("response_timeout", "idle_timeout"), F.lit(False)) if ended is not None else F.lit(False)
    category = (
        F.when(status >= 400, "http_status_failure")
        .when(done == "complete", None)
        .when(done == "reset", "http_reset")
        .when(done.isin("truncated", "partial", "incomplete_capture", "response_only"), "http_incomplete_capture")
        .when(timed_out | done.isin("timeout", "request_only", "no_response"), "http_timeout")
        .otherwise("http_incomplete_capture")
    )
    severity = F.when(status >= 500, "critical").when((status >= 400) | (F.col("category") == "http_timeout"), "error").otherwise("warning")
    return tx.withColumn("category", category).filter("category is not null").withColumn("severity", severity)
