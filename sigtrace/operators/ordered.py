"""Neighbours and positions in long ordered groups, without one task per group.

A window over a group sorts all of it in one task. Here a group is cut into
blocks of consecutive order values: positions and neighbours come from a window
within each block, and what crosses a block's edge from one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _same(left: list[str], right: list[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def with_position(df: DataFrame, by: list[str], block: Column, order: list[str], to: str) -> DataFrame:
    """Positions 1, 2, ... in each group of ``by``, in the order of ``block`` (ascending with ``order``) and ``order``.

    Nulls come first. Ties in ``order`` are numbered in any order, so make it unique.
    """
    b = df.withColumn("_b", block)
    sizes = b.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_b"])], before.alias("_before"))
    inner = b.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    joined = inner.join(offsets, _same([*by, "_b"], [f"_o{i}" for i in range(len(by) + 1)]))
    return joined.withColumn(to, F.col("_before") + F.col("_r")).select(*df.columns, to)


def with_neighbours(df: DataFrame, by: list[str], pos: str, width: int = 4096) -> DataFrame:
    """The positions before and after each row's within its group, as ``<pos>_before`` and ``<pos>_after``, null at the ends."""
    b = df.withColumn("_b", F.floor(F.col(pos) / width))
    edges = b.groupBy(*by, "_b").agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    w = Window.partitionBy(*by).orderBy("_b")
    edges = edges.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_b"])], F.lag("_hi").over(w).alias("_prev"), F.lead("_lo").over(w).alias("_next"))
    v = Window.partitionBy(*by, "_b").orderBy(pos)
    inner = b.withColumn("_l", F.lag(pos).over(v)).withColumn("_h", F.lead(pos).over(v))
    joined = inner.join(edges, _same([*by, "_b"], [f"_o{i}" for i in range(len(by) + 1)]))
    return joined.withColumn(f"{pos}_before", F.coalesce("_l", "_prev")).withColumn(f"{pos}_after", F.coalesce("_h", "_next")).select(*df.columns, f"{pos}_before", f"{pos}_after")


def with_neighbour(df: DataFrame, by: list[str], block: Column, order: list[str], value: Column, to: str, after: bool = False) -> DataFrame:
    """``to``: the ``value`` of the row before (or after) each row in its group, null at the end.

    ``block`` must ascend with ``order``, whose values are to be unique; rows
    with a null block come first.
    """
    b = df.withColumn("_b", block).withColumn("_v", F.struct(value.alias("v")))
    pick = F.min_by if after else F.max_by
    edges = b.groupBy(*by, "_b").agg(pick("_v", F.struct(*order)).alias("_e"))
    w = Window.partitionBy(*by).orderBy("_b")
    edges = edges.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_b"])], (F.lead("_e") if after else F.lag("_e")).over(w).alias("_far"))
    v = Window.partitionBy(*by, "_b").orderBy(*order)
    inner = b.withColumn("_near", (F.lead("_v") if after else F.lag("_v")).over(v))
    joined = inner.join(edges, _same([*by, "_b"], [f"_o{i}" for i in range(len(by) + 1)]))
    return joined.withColumn(to, F.coalesce("_near", "_far")["v"]).select(*df.columns, to)


def with_running_sum(df: DataFrame, by: list[str], block: Column, order: list[str], value: Column, to: str) -> DataFrame:
    """``to``: the sum of ``value`` over the rows of the group up to each row."""
    b = df.withColumn("_b", block).withColumn("_v", value)
    sums = b.groupBy(*by, "_b").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_b"])], F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    v = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.withColumn("_in", F.sum("_v").over(v))
    joined = inner.join(offsets, _same([*by, "_b"], [f"_o{i}" for i in range(len(by) + 1)]))
    return joined.withColumn(to, F.col("_before") + F.col("_in")).select(*df.columns, to)


def running(df: DataFrame, by: list[str], block: Column, order: list[str], aggs: dict[str, tuple]) -> DataFrame:
    """For each ``to: (function, value)`` of ``aggs`` the aggregate of ``value`` over the rows of the group up to each row.

    ``function`` is F.sum, F.min or F.max. One window within blocks, one over
    them, from one shuffle of the rows.
    """
    names = list(aggs)
    b = df.withColumn("_b", block).withColumns({f"_v{i}": aggs[n][1] for i, n in enumerate(names)})
    v = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.withColumns({f"_in{i}": aggs[n][0](f"_v{i}").over(v) for i, n in enumerate(names)})
    blocks = inner.groupBy(*by, "_b").agg(*[aggs[n][0](f"_v{i}").alias(f"_s{i}") for i, n in enumerate(names)])
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_b"])], *[aggs[n][0](f"_s{i}").over(w).alias(f"_p{i}") for i, n in enumerate(names)])
    joined = inner.join(offsets, _same([*by, "_b"], [f"_o{i}" for i in range(len(by) + 1)]))
    both = {}
    for i, n in enumerate(names):
        here, far = F.col(f"_in{i}"), F.col(f"_p{i}")
        both[n] = F.coalesce(here + far, here, far) if aggs[n][0] is F.sum else (F.least if aggs[n][0] is F.min else F.greatest)(here, far)
    return joined.select(*df.columns, *[c.alias(n) for n, c in both.items()])
