"""Evidence: overlapping intervals, answers within a budget, signed cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.operators.joins import level


def overlapping(left: DataFrame, right: DataFrame, by: list[str], lo: str, hi: str, right_lo: str, right_hi: str, width: int) -> DataFrame:
    """Pairs of intervals of the same ``by`` that share a point, each once.

    An interval has the level k whose blocks of ``width`` * 2**k are as long as
    it at least. A pair meets in the blocks of the longer one's level, of which
    either touches two at most, so long intervals are not listed over all that
    they cover; it counts in the block where the later of the two begins.
    Intervals with a null or reversed bound overlap nothing.
    """
    def levelled(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.filter(F.col(a) <= F.col(b)).withColumn("_own", level(F.col(b) - F.col(a) + 1, width))

    def listed(df: DataFrame, a: str, b: str, at) -> DataFrame:
        size = F.lit(width).cast("bigint") * F.expr("shiftleft(1L, _k)")
        return df.withColumn("_k", F.explode(at)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))))

    l, r = levelled(left, lo, hi), levelled(right, right_lo, right_hi)
    levels = lambda df: F.sort_array(df.agg(F.collect_set("_own")).scalar())
    of_l, of_r = levels(l), levels(r)

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        p, q = x.alias("l"), y.alias("r")
        cond = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*by, "_k", "_b"]]
        cond += [F.col(f"l.{lo}") <= F.col(f"r.{right_hi}"), F.col(f"r.{right_lo}") <= F.col(f"l.{hi}")]
        cond += [F.col("l._b") == F.floor(F.greatest(F.col(f"l.{lo}"), F.col(f"r.{right_lo}")) / (F.lit(width).cast("bigint") * F.expr("shiftleft(1L, l._k)")))]
        return p.join(q, cond).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c not in by])

    own = F.array("_own")
    l_up, r_up = l.withColumn("_levels", of_r), r.withColumn("_levels", of_l)
    longer = meet(listed(l, lo, hi, own), listed(r_up, right_lo, right_hi, F.filter("_levels", lambda k: k >= F.col("_own"))))
    return longer.unionAll(meet(listed(l_up, lo, hi, F.filter("_levels", lambda k: k > F.col("_own"))), listed(r, right_lo, right_hi, own)))


def canonical(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode()


def trim(answer: dict, order: list[str], most: int) -> tuple[dict, dict[str, int]]:
    """One answer cut to ``most`` bytes of canonical JSON: lists are shortened from their ends, in ``order``.

    Gives the answer and how many items each list lost; raises if what may not
    be cut is too large. For single answers on the driver.
    """
    out, lost = dict(answer), {}
    for name in order:
        items = list(out.get(name) or [])
        while items and len(canonical(out)) > most:
            items.pop()
            out[name] = items
            lost[name] = lost.get(name, 0) + 1
    if len(canonical(out)) > most:
        raise ValueError(f"{len(canonical(out))} bytes; at most {most}")
    return out, lost


def make_cursor(state: dict, key: bytes) -> str:
    """A place in an answer as a text that only the holder of ``key`` can make."""
    body = canonical(state)
    return base64.urlsafe_b64encode(hmac.new(key, body, hashlib.sha256).digest() + body).decode().rstrip("=")


def read_cursor(cursor: str, key: bytes) -> dict:
    raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
    if not hmac.compare_digest(raw[:32], hmac.new(key, raw[32:], hashlib.sha256).digest()):
        raise ValueError("the cursor was changed")
    return json.loads(raw[32:])
