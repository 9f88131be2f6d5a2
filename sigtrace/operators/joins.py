"""Joins by time and place: validity, as-of, intervals, neighbourhoods, comparisons.

Range conditions are turned into equi-joins on (key, bucket), so they neither
become nested loops nor put a hot key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.operators.ordered import _same, running


def level(length: Column, width: int) -> Column:
    """The smallest k with ``width`` * 2**k >= ``length``."""
    return F.greatest(F.ceil(F.log2(length / F.lit(width))), F.lit(0)).cast("int")


def in_interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points with the spans of the same ``by`` values around them, bounds included; a null ``hi`` is open.

    A span has the level k whose blocks of ``width`` * 2**k are as long as it at
    least, so it touches two of them at most, however long it is; points are
    looked up once in each level there is, of which there are no more than 64.
    Open spans end with the last point. Columns of ``spans`` must have other
    names, but for ``by``. Null keys and points match nothing.
    """
    end = points.agg(F.max(at).cast("bigint").alias("_end")).scalar()
    s = spans.withColumn("_hi", F.coalesce(F.col(hi), F.greatest(F.col(lo), end))).filter(F.col(lo).isNotNull() & (F.col("_hi") >= F.col(lo)))
    s = s.withColumn("_k", level(F.col("_hi") - F.col(lo) + 1, width))
    levels = F.sort_array(s.agg(F.collect_set("_k").alias("_k")).scalar())
    size = F.lit(width).cast("bigint") * F.expr("shiftleft(1L, _k)")
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col("_hi") / size))))
    p = points.withColumn("_k", F.explode(levels)).withColumn("_b", F.floor(F.col(at) / size))
    joined = p.alias("p").join(s.alias("s"), [F.col(f"p.{c}") == F.col(f"s.{c}") for c in [*by, "_k", "_b"]] + [F.col(f"p.{at}").between(F.col(f"s.{lo}"), F.col("s._hi"))])
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in spans.columns if c not in by])


def valid_counts(points: DataFrame, spans: DataFrame, by: list[str], at: str, lo: str, hi: str, value: str, width: int) -> DataFrame:
    """``by, at, n_valid, first_valid``: of the spans around each distinct point how many there are, and the least ``value``.

    Spans with an end are looked up by ``in_interval``; of open ones, which hold
    for all that follows, a running count and minimum says as much, so no pairs
    of them are built. Points in no span have no row.
    """
    p = points.select(*by, at).filter(F.col(at).isNotNull()).distinct()
    closed = in_interval(p, spans.filter(F.col(hi).isNotNull()), by, at, lo, hi, width).select(*by, at, F.lit(1).cast("bigint").alias("_n"), F.col(value).alias("_v"))
    facts = spans.filter(F.col(hi).isNull() & F.col(lo).isNotNull()).groupBy(*by, F.col(lo).alias("_t")).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    both = facts.withColumn("_p", F.lit(0)).unionByName(p.select(*by, F.col(at).alias("_t"), F.lit(0).cast("bigint").alias("_n"), F.lit(None).cast(spans.schema[value].dataType).alias("_v"), F.lit(1).alias("_p")))
    open_ = running(both, by, F.floor(F.col("_t") / width), ["_t", "_p"], {"_rn": (F.sum, F.col("_n")), "_rv": (F.min, F.col("_v"))})
    open_ = open_.filter("_p = 1 and _rn > 0").select(*by, F.col("_t").alias(at), F.col("_rn").alias("_n"), F.col("_rv").alias("_v"))
    return closed.unionByName(open_).groupBy(*by, at).agg(F.sum("_n").alias("n_valid"), F.min("_v").alias("first_valid"))


def last_before(points: DataFrame, facts: DataFrame, by: list[str], at: str, when: str, take: list[str], width: int = 1 << 16) -> DataFrame:
    """As-of: to each point the ``take`` columns of the latest fact of the same ``by`` with ``when`` <= ``at``, as ``as_of_...``.

    One union and a window per block of ``width``, no range join, so a hot key is
    spread; of facts at the same ``when`` the one greatest by ``take`` counts.
    Points without a fact get nulls, points with a null ``at`` too. Null keys
    equal each other.
    """
    found = F.struct(F.col(when).alias("w"), *[F.col(c).alias(c) for c in take])
    f = facts.filter(F.col(when).isNotNull()).select(*by, F.col(when).alias("_t"), found.alias("_f")).groupBy(*by, "_t").agg(F.max("_f").alias("_f"))
    p = points.select(*by, F.col(at).alias("_t"), F.struct(*[F.col(c) for c in points.columns]).alias("_p"))
    both = f.withColumn("_p", F.lit(None).cast(p.schema["_p"].dataType)).unionByName(p.withColumn("_f", F.lit(None).cast(f.schema["_f"].dataType)))
    both = both.withColumn("_b", F.floor(F.col("_t") / width))
    edges = both.groupBy(*by, "_b").agg(F.max("_f").alias("_e"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_b"])], F.last("_e", ignorenulls=True).over(w).alias("_far"))
    v = Window.partitionBy(*by, "_b").orderBy("_t", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_l", F.last("_f", ignorenulls=True).over(v)).filter("_p is not null")
    joined = near.join(edges, _same([*by, "_b"], [f"_o{i}" for i in range(len(by) + 1)]))
    return joined.withColumn("_l", F.coalesce("_l", "_far")).select("_p.*", *[F.col(f"_l.{c}").alias(f"as_of_{c}") for c in take])


def around(anchors: DataFrame, rows: DataFrame, anchor: str, at: str, before: int, after: int) -> DataFrame:
    """Rows within ``before`` and ``after`` of each anchor, both positions integers."""
    a = anchors.withColumn("_from", F.col(anchor) - before).withColumn("_to", F.col(anchor) + after).withColumn("_one", F.lit(1))
    width = max(before + after, 1)
    return in_interval(rows.withColumn("_one", F.lit(1)), a, ["_one"], at, "_from", "_to", width).drop("_one", "_from", "_to")


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer alignment: ``relation`` is matched, changed, missing (left only) or extra (right only)."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    relation = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").when(F.col("left_value").eqNullSafe(F.col("right_value")), "matched").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, "left_value", "right_value", relation.alias("relation"))


def similarity(pairs: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Matches over fields of which either side has a value; 1.0 if there is none."""
    some = F.col(left).isNotNull() | F.col(right).isNotNull()
    return pairs.groupBy(*by).agg(F.coalesce(F.count_if(some & F.col(left).eqNullSafe(F.col(right))) / F.nullif(F.count_if(some), F.lit(0)), F.lit(1.0)).alias("similarity"))


def latest_valid(points: DataFrame, spans: DataFrame, by: list[str], at: str, lo: str, hi: str, tie: Column, width: int, key: list[str]) -> DataFrame:
    """Of the spans valid at each point the one that began last, then the smallest ``tie``; ``key`` identifies a point.

    One aggregate with a partial step, so a point in many spans is reduced before
    the shuffle. Points in no span have no row.
    """
    found = in_interval(points, spans, by, at, lo, hi, width)
    rest = [c for c in found.columns if c not in key]
    best = F.min(F.struct((-F.col(lo)).alias("l"), tie.alias("t"), F.struct(*rest).alias("r")))
    return found.groupBy(*key).agg(best.alias("_x")).select(*key, "_x.r.*").select(*found.columns)
