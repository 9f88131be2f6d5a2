"""One copy of each message: keys, and the batch form of the deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_text(parts: list[Column]) -> Column:
    """One text for a compound key in which null equals null and differs from everything else."""
    return F.concat(*[F.coalesce(F.concat(F.lit("="), p.cast("string"), F.lit("\u001f")), F.lit("!\u001f")) for p in parts])


def key_hashes(text: Column) -> tuple[Column, Column]:
    """A 128-bit fingerprint of a ``key_text`` as two BIGINTs.

    For n keys the chance of any collision is below n*n / 2**129: about 1e-17
    for 100 billion keys.
    """
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def first_copies(df: DataFrame, keys: dict[str, Column], order: list[str], take: dict[str, Column]) -> DataFrame:
    """One row per key: the ``take`` columns of the row that is first by ``order``.

    Partial aggregation keeps one row per key and task before the shuffle, so a
    key with a third of all rows costs no more than others. Null keys equal
    each other; null order values come last; rows that tie in ``order`` are
    taken in the order of their ``take`` values. An empty table gives an empty one.
    """
    best = F.min(F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"o{i}"))], F.struct(*[v.alias(k) for k, v in take.items()]).alias("t")))
    return df.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.t.{k}").alias(k) for k in take])
