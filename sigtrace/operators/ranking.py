"""Scores, ranks, stages and timelines of attempts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def clamped_sum(terms: list[Column]) -> Column:
    """The sum of score terms, nulls as 0, between 0 and 1, as DECIMAL(10,4) rounded half to even."""
    total = F.lit(0).cast("decimal(12,6)")
    for t in terms:
        total = total + F.coalesce(t.cast("decimal(12,6)"), F.lit(0).cast("decimal(12,6)"))
    return F.bround(F.least(F.greatest(total, F.lit(0).cast("decimal(12,6)")), F.lit(1).cast("decimal(12,6)")), 4).cast("decimal(10,4)")


def rank(candidates: DataFrame, by: list[str], score: str, ties: list[Column], least: float, margin: float) -> DataFrame:
    """Ranks of candidates of at least ``least``: the first is primary, those within ``margin`` of it alternatives, others downstream."""
    kept = candidates.filter(F.col(score) >= least)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    r = kept.withColumn("candidate_rank", F.row_number().over(w)).withColumn("_top", F.first(score).over(w))
    label = F.when(F.col("candidate_rank") == 1, "primary").when(F.col("_top") - F.col(score) <= margin, "alternative").otherwise("downstream")
    return r.withColumn("classification", label).drop("_top")


def stage_states(attempts: DataFrame, seen: DataFrame, stages: list[str], by: list[str]) -> DataFrame:
    """Per attempt and stage: completed if seen, missing if all before it are completed, else skipped."""
    listed = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(stages)])
    grid = attempts.select(*by, F.explode(listed).alias("s")).select(*by, "s.*")
    first = seen.groupBy(*by, "stage").agg(F.min("frame").alias("first_frame"))
    g = grid.join(first, [*by, "stage"], "left")
    w = Window.partitionBy(*by).orderBy("stage_no").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.max(F.col("first_frame").isNull()).over(w), F.lit(False))
    return g.withColumn("state", F.when(F.col("first_frame").isNotNull(), "completed").when(gap, "skipped").otherwise("missing"))


def first_divergence(aligned: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each group the first row in order that is not matched."""
    return aligned.filter("relation != 'matched'").groupBy(*by).agg(F.min(F.struct(*order, "relation")).alias("_f")).select(*by, "_f.*")


def with_occurrence(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def timeline(items: list[DataFrame], by: list[str], order: list[str], most: int | None = None, skip: int = 0) -> DataFrame:
    """Items of different kinds in one order, numbered from 0: those of each group from ``skip`` to before ``most``."""
    all_ = items[0]
    for i in items[1:]:
        all_ = all_.unionByName(i, allowMissingColumns=True)
    t = all_.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    t = t if most is None else t.filter(F.col("ordinal") <= most)  # so that only as many of each task are shuffled
    return t.withColumn("ordinal", F.col("ordinal") - 1).filter(F.col("ordinal") >= skip)


def pages(rows: DataFrame, by: list[str], order: list[str], size: Column, most_bytes: int, most_rows: int) -> DataFrame:
    """Greedy pages of each group, bounded by bytes and rows; a row larger than a page has its own.

    Packing is sequential, so a group goes through one task, but as a sorted
    stream of batches with two numbers of state.
    """
    sized = rows.select(*by, *order, size.cast("bigint").alias("size"))
    ordered = sized.repartition(*by).sortWithinPartitions(*by, *order)

    def run(frames):
        now, page, used, n = None, 0, 0, 0
        for f in frames:
            out = []
            for key, s in zip(zip(*[f[c] for c in by]), f["size"]):
                s = int(s) if s == s else 0
                if key != now:
                    now, page, used, n = key, 0, 0, 0
                elif n and (used + s > most_bytes or n >= most_rows):
                    page, used, n = page + 1, 0, 0
                used, n = used + s, n + 1
                out.append(page)
            f["page"] = out
            yield f

    return ordered.mapInPandas(run, T.StructType([*sized.schema.fields, T.StructField("page", T.IntegerType())]))


def ordered_digest(rows: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    """SHA-256 over the digests of a group's texts, one a line, in order; a stream through one task with the hash as its state."""
    ordered = rows.select(by, *order, F.sha2(F.col(text).cast("string"), 256).alias("_h")).repartition(by).sortWithinPartitions(by, *order)

    def run(frames):
        now, hash_ = None, None
        for f in frames:
            out = []
            for key, h in zip(f[by], f["_h"]):
                if h is None:
                    continue
                if hash_ is not None and key == now:
                    hash_.update(b"\n" + h.encode())
                    continue
                if hash_ is not None:
                    out.append((now, hash_.hexdigest()))
                now, hash_ = key, hashlib.sha256(h.encode())
            yield pd.DataFrame(out, columns=[by, "digest"])
        if hash_ is not None:
            yield pd.DataFrame([(now, hash_.hexdigest())], columns=[by, "digest"])

    return ordered.mapInPandas(run, T.StructType([ordered.schema[by], T.StructField("digest", T.StringType())]))
