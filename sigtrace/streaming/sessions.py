"""Sessions of an event stream that end after a silence: those a watermark closes, or all, however late an event comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.sources.shared import RunFolder


def sessions(stream: DataFrame, by: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions per ``by``: ``start``, ``last`` event, number of events. Works on streams and tables alike."""
    return grouped(stream.withWatermark(time, delay), by, time, gap)


def grouped(events: DataFrame, by: str, time: str, gap: str) -> DataFrame:
    s = events.groupBy(by, F.session_window(time, gap)).agg(F.count("*").alias("n_events"), F.max(time).alias("last"))
    return s.select(by, F.col("session_window.start").alias("start"), "last", "n_events")


def settle(parts: DataFrame, by: str, gap: str) -> DataFrame:
    """Sessions of parts of a stream put together: those of one key with no silence of ``gap`` between them are one.

    A key's parts stream through one task in the order of their starts.
    """
    w = Window.partitionBy(by).orderBy("start", "last")
    ends = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) + F.expr(f"INTERVAL '{gap}'")
    p = parts.withColumn("_new", F.coalesce(F.col("start") > ends, F.lit(True)).cast("int"))
    p = p.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(by, "_no").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n_events").alias("n_events")).drop("_no")


def run_sessions(stream: DataFrame, by: str, time: str, gap: str, folder: RunFolder) -> DataFrame:
    """Run what is available through the stream and give all its sessions, those still open at its end too.

    Each micro-batch leaves its own sessions in a ledger, under its number, so
    that one run again after a failure counts once; they are put together at the
    end. There is no watermark, so no event is too late for its session and the
    result doesn't depend on how the input is cut into micro-batches.
    """
    spark, ledger = folder.spark, f"{folder.path}/sessions"
    schema = grouped(stream, by, time, gap).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{ledger}/batch=-1")  # a stream may be empty

    def keep(batch: DataFrame, number: int) -> None:
        grouped(batch, by, time, gap).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder.path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return settle(spark.read.schema(schema).parquet(ledger).select(*schema.names), by, gap)
