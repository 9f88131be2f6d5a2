"""Phases of a capture by a sweep over attempts' edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sweep(spans: DataFrame, lo: str, hi: str, roll: int, first: Column | int, last: Column | int, block: int = 1 << 16) -> DataFrame:
    """Disjoint phases ``from_frame, to_frame, n_active, phase`` covering ``first`` to ``last`` (numbers or scalar subqueries).

    Each span is widened by ``roll`` and clamped; +1 at its start and -1 after
    its end are added up by frame first, then summed within blocks of frames and
    over blocks, so no task holds all edges.
    """
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    s = spans.select(F.greatest(F.col(lo) - roll, first).alias("a"), F.least(F.col(hi) + roll, last).alias("b")).filter("a <= b")
    one = spans.sparkSession.range(1).select(first.cast("bigint").alias("frame"), F.lit(0).alias("d"))
    edges = s.select(F.col("a").cast("bigint").alias("frame"), F.lit(1).alias("d")).unionAll(s.select((F.col("b") + 1).cast("bigint"), F.lit(-1))).unionAll(one)
    e = edges.groupBy("frame").agg(F.sum("d").alias("d")).withColumn("_b", F.floor(F.col("frame") / block))
    blocks = e.groupBy("_b").agg(F.sum("d").alias("_d"), F.min("frame").alias("_lo"))
    w = Window.orderBy("_b")
    before = blocks.select("_b", F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_lo").over(w).alias("_next"))
    v = Window.partitionBy("_b").orderBy("frame")
    inner = e.withColumn("_in", F.sum("d").over(v.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_f", F.lead("frame").over(v))
    p = inner.join(before, "_b").select(F.col("frame").alias("from_frame"), (F.coalesce("_f", "_next", last + 1) - 1).alias("to_frame"), (F.col("_before") + F.col("_in")).alias("n_active"))
    a, z = s.agg(F.min("a")).scalar(), s.agg(F.max("b")).scalar()
    phase = F.when(F.col("n_active") > 0, "attempt_active").when(a.isNull() | (F.col("to_frame") < a), "capture_preamble").when(F.col("from_frame") > z, "capture_postamble").otherwise("between_attempts")
    return p.filter(F.col("from_frame") <= last).withColumn("phase", phase)
