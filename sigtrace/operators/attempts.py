"""Segmenting each subject's timeline into attempts: triggers, stages, timeouts, terminals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sigtrace.operators.ordered import _same, running, with_neighbour, with_position


@dataclass(frozen=True)
class Profile:
    """A procedure: what opens an attempt, its stages in order, what ends it, and how long it may be silent."""

    profile_id: str
    triggers: tuple[str, ...]
    success: tuple[str, ...]
    failure: tuple[str, ...]
    timeout: int
    stages: tuple[str, ...] = ()


ATTEMPTS = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("profile_id", T.StringType()),
        T.StructField("start_frame", T.LongType()),
        T.StructField("end_frame", T.LongType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


def segment_attempts(events: DataFrame, profiles: list[Profile], capture_end: int, subject: str = "subject") -> DataFrame:
    """Attempts of each subject by several profiles: events ``subject, frame, time, message_type``.

    In order of frame, an event first expires open attempts that were silent
    beyond their timeout, then opens an attempt if it triggers a profile that has
    none open, joins the open attempts whose stages name it, and
    closes those for which it is terminal. Open attempts at the end (and before a
    silence beyond all timeouts, which no attempt survives) are timed out
    or incomplete. A subject's timeline is cut where it is silent beyond all
    timeouts, as no attempt goes on there, and its pieces are spread over tasks;
    each streams through one as sorted Arrow batches with a few open attempts as
    its state.
    """
    src = events.select(F.col(subject).cast("string").alias("subject"), F.col("frame").cast("bigint").alias("frame"), F.col("time").cast("bigint").alias("time"), "message_type").filter("subject is not null")
    # Silence counts from the latest time so far, should times not follow the frames.
    src = running(src, ["subject"], F.floor(F.col("frame") / BLOCK), ["frame", "message_type"], {"_latest": (F.max, F.col("time"))})
    src = islands(src, ["subject"], "frame", "_latest", max((p.timeout for p in profiles), default=0), F.lit(False)).withColumnRenamed("attempt_no", "piece").drop("_latest")
    ordered = src.repartition("subject", "piece").sortWithinPartitions("subject", "piece", "frame", "message_type")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = at = None
        live: dict[str, dict] = {}

        def close(a: dict, outcome: str, reason: str) -> tuple:
            return (now, a["p"].profile_id, a["f0"], a["f1"], a["t0"], a["t1"], a["n"], outcome, reason)

        def finish() -> list[tuple]:
            out = []
            for a in live.values():
                late = capture_end - a["t1"] > a["p"].timeout
                out.append(close(a, "timed_out" if late else "incomplete_capture", "response_timeout" if late else "capture_ended_before_terminal"))
            live.clear()
            return out

        for f in frames:
            out: list[tuple] = []
            for s, piece, frame, time, kind in zip(f["subject"], f["piece"], f["frame"], f["time"], f["message_type"]):
                if (s, piece) != at:
                    out += finish()
                    now, at = s, (s, piece)
                for pid in [pid for pid, a in live.items() if time - a["t1"] > a["p"].timeout]:
                    out.append(close(live.pop(pid), "timed_out", "response_timeout"))
                for p in profiles:
                    if kind in p.triggers and p.profile_id not in live:
                        live[p.profile_id] = {"p": p, "f0": frame, "f1": frame, "t0": time, "t1": time, "n": 0}
                for pid, a in list(live.items()):
                    p = a["p"]
                    if kind in p.stages or kind in p.triggers or kind in p.success or kind in p.failure:
                        a["f1"], a["t1"], a["n"] = frame, time, a["n"] + 1
                        if kind in p.success:
                            out.append(close(live.pop(pid), "succeeded", "success_terminal"))
                        elif kind in p.failure:
                            out.append(close(live.pop(pid), "failed", "failure_terminal"))
            if out:
                yield pd.DataFrame(out, columns=ATTEMPTS.names)
        out = finish()
        if out:
            yield pd.DataFrame(out, columns=ATTEMPTS.names)

    return ordered.mapInPandas(run, ATTEMPTS)


BLOCK = 1 << 16  # frames of one block of a subject's timeline


def islands(events: DataFrame, by: list[str], order: str, time: str, gap: int, last: Column) -> DataFrame:
    """Single-profile mode without Python: an attempt ends after a ``last`` event or a silence beyond ``gap``.

    Adds ``attempt_no`` from 1 to each event. ``order`` is a unique integer; at
    events without a time nothing is silent. A
    subject's timeline is cut into blocks of it, so a hot subject is spread: one
    window within blocks gives what starts there, one over the blocks what came
    before, both from one shuffle of the events.
    """
    e = events.withColumn("_b", F.floor(F.col(order) / BLOCK)).withColumn("_e", F.struct(F.col(time).alias("t"), F.coalesce(last, F.lit(False)).alias("l")))
    v = Window.partitionBy(*by, "_b").orderBy(order)
    new = lambda p, t: ((t - p["t"] > gap) | p["l"]).cast("int")
    inner = e.withColumn("_s", F.coalesce(new(F.lag("_e").over(v), F.col(time)), F.lit(0))).withColumn("_in", F.sum("_s").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = inner.groupBy(*by, "_b").agg(F.min(F.struct(order, time))[time].alias("_first"), F.max_by("_e", order).alias("_last"), F.sum("_s").alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_b")
    prior = F.lag("_last").over(w)
    begins = F.when(prior.isNull(), 1).otherwise(F.coalesce(new(prior, F.col("_first")), F.lit(0)))
    blocks = blocks.withColumn("_begins", begins)
    before = F.sum(F.col("_begins")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_b"])], before.alias("_before"))
    joined = inner.join(offsets, _same([*by, "_b"], [f"_o{i}" for i in range(len(by) + 1)]))
    return joined.select(*events.columns, (F.col("_before") + F.col("_in")).alias("attempt_no"))


def summarise(labelled: DataFrame, by: list[str], success: Column, failure: Column, time: str, capture_end: Column, gap: int) -> DataFrame:
    """Attempts of labelled events: interval, events, outcome and reason."""
    a = labelled.groupBy(*by, "attempt_no").agg(
        F.min("frame").alias("start_frame"),
        F.max("frame").alias("end_frame"),
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        F.count("*").alias("n_events"),
        F.coalesce(F.bool_or(success), F.lit(False)).alias("_ok"),
        F.coalesce(F.bool_or(failure), F.lit(False)).alias("_bad"),
    )
    late = capture_end - F.col("end_time") > gap
    outcome = F.when(F.col("_ok"), "succeeded").when(F.col("_bad"), "failed").when(late, "timed_out").otherwise("incomplete_capture")
    return a.withColumn("outcome", outcome).drop("_ok", "_bad")


def link_retries(attempts: DataFrame, by: list[str], order: str, start: str, end: str, within: int) -> DataFrame:
    """Sequence numbers, and of each attempt the failed one before it in the order of completion that it retries."""
    block = F.floor(F.col(order) / BLOCK)
    before = F.struct(F.col("outcome").alias("o"), F.col(end).alias("e"), F.col("attempt_no").alias("a"))
    a = with_neighbour(with_position(attempts, by, block, [order], "sequence_no"), by, block, [order], before, "_p")
    retry = F.col("_p.o").isin("failed", "timed_out") & (F.col(start) - F.col("_p.e") <= within)
    return a.withColumn("retry_of", F.when(retry, F.col("_p.a"))).drop("_p")
