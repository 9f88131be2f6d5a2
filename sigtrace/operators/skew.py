"""Joins that keep hot keys out of single tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 20_000  # rows of one key from which on it is joined by broadcast
MOST_HOT = 1 << 20  # keys that are broadcast at most, about 40 MB: of more rows a key must have more to be hot


def hot_size(rows: int) -> int:
    """Rows of a key from which on it is hot, of so many rows in all: at most MOST_HOT keys are."""
    return max(HOT, -(-rows // MOST_HOT))


def join_hot(rows: DataFrame, facts: DataFrame, key: str, fact: str, spread: str, hot_rows: int | None = None) -> DataFrame:
    """``rows`` with the ``fact`` of their ``key``, null where there is none.

    ``facts`` has one row per key; if it has a column ``size``, that is the number
    of rows of the key, else rows are counted here. Facts of keys with at least
    ``hot_rows`` rows (HOT) are broadcast: n rows have at most n / HOT such keys.
    The rows that find theirs there are spread by ``spread`` over the tasks of the
    shuffle join that all others need, so nothing is read twice. With the
    ``hot_size`` of the number of rows as ``hot_rows`` the broadcast is bounded
    however many rows there are.
    """
    least = HOT if hot_rows is None else hot_rows
    if "size" in facts.columns:
        sized, big = facts, facts.filter(F.col("size") >= least)
    else:
        keys = rows.groupBy(key).agg(F.count("*").alias("size")).filter(F.col("size") >= least).select(key)
        sized, big = facts.withColumn("size", F.lit(None).cast("bigint")), facts.join(F.broadcast(keys), key, "left_semi")
    hot = F.broadcast(big.select(F.col(key).alias("_hot_key"), F.col(fact).alias("_hot")))
    # Not a literal, or the optimizer would take the second key out of the join.
    cold = sized.select(F.col(key).alias("_cold_key"), F.col(fact).alias("_cold"), F.coalesce(F.col("size") < 0, F.isnull(key)).cast("int").alias("_cold_at"))
    marked = rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
    marked = marked.withColumn("_at", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("int"))
    joined = marked.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_at") == F.col("_cold_at")), "left")
    return joined.select(*rows.columns, F.coalesce("_hot", "_cold").alias(fact))
