"""Mixing sources to target shares of all tokens, as a curriculum whose weights vary over training.

Each source has a weight schedule over training time t in [0, 1], piecewise
linear, from a table or by default one that tilts towards sources that may be
repeated more. Its integral up to t, scaled so that the whole is the source's
share of the mix's tokens, is the source's cumulative demand. A source's
documents stand in one pseudo-random order, repeated as often as needed; the
tokens before a copy, put into the inverse of the demand, give the copy's
training position, and copies are range-sorted by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sigtrace.sources.shared import RunFolder

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ORDER_BITS = 12  # a source's order is cut into 2 ** ORDER_BITS blocks for prefix sums
TOLERANCE = 0.001  # of a demand: sources that miss more are filled up
PASSES = 8  # at most so many documents fill a source up


def source_name(c: Column) -> Column:
    """A source however written: lower case, blanks and hyphens as underscores; null if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"^\s+|\s+$", ""), r"[\s\-_]+", "_")
    return F.when(name != "", name)


def token_counts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of each text, null and empty texts with 0. ``tokenizer`` is a file of ranks."""
    source = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])
    names, n = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(n).to_pylist()]
            yield pa.record_batch([*[batch.column(i) for i in range(n)], pa.array(counts, pa.int64())], names=names)

    return source.mapInArrow(run, schema)


def before_each(docs: DataFrame, by: str, size: str, ident: str, seed: int) -> DataFrame:
    """``docs`` with ``_before``: the sum of ``size`` of all documents of the source that come before in its pseudo-random order.

    Two steps, so that no source is sorted in one task: sums within hash blocks
    of the order, and of the blocks before.
    """
    h = docs.withColumn("_h", F.xxhash64(F.lit(seed), F.col(ident))).withColumn("_b", F.shiftright("_h", 64 - ORDER_BITS))
    blocks = h.groupBy(by, "_b").agg(F.sum(size).alias("_size"))
    w = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(by, "_b", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_offset"))
    v = Window.partitionBy(by, "_b").orderBy("_h", ident, size).rowsBetween(Window.unboundedPreceding, -1)
    inner = h.withColumn("_inner", F.coalesce(F.sum(size).over(v), F.lit(0)))
    return inner.join(offsets, [by, "_b"]).withColumn("_before", F.col("_offset") + F.col("_inner")).drop("_h", "_b", "_offset", "_inner")


def clean_targets(targets: DataFrame) -> DataFrame:
    """Targets by mix and normalised source; rows of one source are added up, shares that are null or negative count as none."""
    t = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("repeats"))
    return t.filter("source is not null").groupBy("mix_name", "source").agg(F.sum("share").alias("target_share"), F.max("repeats").alias("max_repeats"))


SCHEDULE = "array<struct<at: double, weight: double>>"


def clean_schedules(schedules: DataFrame) -> DataFrame:
    """``mix_name, source, points``: the weights of each schedule in the order of time, times beyond [0, 1] left out.

    Null and negative weights count as 0; of several at one time the greatest
    counts; before the first and after the last point the weight stays. A
    schedule without any positive weight is none.
    """
    s = schedules.select("mix_name", source_name(F.col("source")).alias("source"), F.col("at").cast("double").alias("at"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    s = s.filter("source is not null and at between 0 and 1").groupBy("mix_name", "source", "at").agg(F.max("weight").alias("weight"))
    s = s.groupBy("mix_name", "source").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("p"), F.max("weight").alias("_most"))
    point = lambda at, of: F.array(F.struct(F.lit(at).alias("at"), of["weight"].alias("weight")))
    whole = F.concat(point(0.0, F.get("p", F.lit(0))), F.col("p"), point(1.0, F.element_at("p", -1)))
    return s.filter("_most > 0").select("mix_name", "source", whole.cast(SCHEDULE).alias("points"))


def integrated(points: Column) -> Column:
    """The pieces of a schedule: ``at, span, w0, w1`` and the integral ``before`` each."""
    step = lambda acc, i: F.struct(
        F.concat(acc["out"], F.array(F.struct(
            F.get(points, i)["at"].alias("at"), (F.get(points, i + 1)["at"] - F.get(points, i)["at"]).alias("span"),
            F.get(points, i)["weight"].alias("w0"), F.get(points, i + 1)["weight"].alias("w1"), acc["area"].alias("before"),
        ))).alias("out"),
        (acc["area"] + (F.get(points, i + 1)["at"] - F.get(points, i)["at"]) * (F.get(points, i)["weight"] + F.get(points, i + 1)["weight"]) / 2).alias("area"),
    )
    pieces = "array<struct<at: double, span: double, w0: double, w1: double, before: double>>"
    start = F.struct(F.array().cast(pieces).alias("out"), F.lit(0.0).alias("area"))
    return F.aggregate(F.sequence(F.lit(0), F.size(points) - 2), start, step)


def plan_mix(targets: DataFrame, available: DataFrame, total_tokens: float | None = None, tilt: float = 0.5, schedules: DataFrame | None = None) -> DataFrame:
    """By mix and source: share, demand in tokens, and the schedule as ``pieces`` with their whole ``area``.

    Targets of sources without documents go to the others in proportion.
    Without ``total_tokens`` a mix is as large as it can be with every share met
    and no document above its repeats. With it, a source whose demand is beyond
    its repeats gives all it may. ``schedules`` has rows ``mix_name, source, at,
    weight``. Sources without get one by which those that may be repeated more
    often come later: the weight moves linearly by up to ``tilt`` of the share,
    so that without any schedule all weights add up to 1 at any time.
    """
    t = targets.join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    mix = Window.partitionBy("mix_name")
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0)
    t = t.withColumn("usable", F.when(usable, F.col("target_share")).otherwise(0.0))
    t = t.withColumn("share", F.col("usable") / F.nullif(F.sum("usable").over(mix), F.lit(0.0)))
    limit = F.col("available") * F.col("max_repeats")
    size = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.when(F.col("share") > 0, limit / F.col("share"))).over(mix)
    t = t.withColumn("size", size).withColumn("demand", F.when(F.col("share") > 0, F.least(F.col("share") * F.col("size"), limit.cast("double"))).otherwise(0.0))
    mean = F.sum(F.col("share") * F.col("max_repeats")).over(mix)
    t = t.withColumn("_mean", mean)
    furthest = F.max(F.when(F.col("share") > 0, F.abs(F.col("max_repeats") - F.col("_mean")))).over(mix)
    t = t.withColumn("_far", furthest)
    lean = F.when(F.col("_far") > 0, tilt * (F.col("max_repeats") - F.col("_mean")) / F.col("_far")).otherwise(0.0)
    point = lambda at, w: F.struct(F.lit(at).alias("at"), w.alias("weight"))
    points = F.array(point(0.0, F.coalesce("share", F.lit(0.0)) * (1 - lean)), point(1.0, F.coalesce("share", F.lit(0.0)) * (1 + lean))).cast(SCHEDULE)
    if schedules is None:
        t = t.withColumn("points", points)
    else:
        t = t.join(clean_schedules(schedules), ["mix_name", "source"], "left").withColumn("points", F.coalesce("points", points))
    whole = integrated(F.col("points"))
    return t.withColumn("_i", whole).withColumn("pieces", F.col("_i.out")).withColumn("area", F.col("_i.area")).drop("usable", "_mean", "_far", "points", "_i")


def position(part: Column, pieces: Column, area: Column) -> Column:
    """The time at which a schedule has integrated to ``part`` of its whole ``area``."""
    x = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * area
    p = F.element_at(F.filter(pieces, lambda k: k["before"] <= x), -1)
    y = x - p["before"]
    root = p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * (p["w1"] - p["w0"]) * y / F.nullif(p["span"], F.lit(0.0)), F.lit(0.0)))
    return F.least(p["at"] + F.least(F.coalesce(2 * y / F.nullif(root, F.lit(0.0)), F.lit(0.0)), p["span"]), F.lit(1.0))


class Mix:
    """``copies``: mix_name, source, doc_id, copy_no, n_tokens, position. ``shares``: what each source was to reach and reached."""

    def __init__(self, copies: DataFrame, plan: DataFrame):
        self.copies = copies
        self.plan = plan

    @property
    def ordered(self) -> DataFrame:
        """The copies of each mix in the order of training, range-sorted."""
        return self.copies.repartitionByRange("mix_name", "position", "doc_id", "copy_no").sortWithinPartitions("mix_name", "position", "doc_id", "copy_no")

    @property
    def shares(self) -> DataFrame:
        got = self.copies.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_copies"), F.max("copy_no").alias("most_copies"))
        s = self.plan.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "n_copies", "most_copies"])
        all_ = F.sum("tokens").over(Window.partitionBy("mix_name"))
        return s.select("mix_name", "source", "target_share", (F.col("tokens") / F.nullif(all_, F.lit(0))).alias("reached_share"), "tokens", "n_copies", "most_copies", "max_repeats", "available", "demand")


def fill(placed: DataFrame, plan: DataFrame, folder: RunFolder) -> tuple[DataFrame, DataFrame]:
    """How far each source fills its demand: ``state`` (mix_name, source, rounds, rest, filled) and ``extra`` documents.

    All documents are taken in ``rounds`` full rounds, then in one more those
    that fit into the ``rest`` in their order. A source that still misses more
    than TOLERANCE takes the largest document that fits, again and again (PASSES
    at most), at last the one nearest in size to what is missing if it would
    miss less with it. Extra rows are known by their ``_before``.
    """
    rounds = F.floor(F.col("demand") / F.col("available") + 1e-9)
    wanted = plan.filter("demand > 0").select("mix_name", "source", "demand", rounds.alias("rounds"), (F.col("demand") - rounds * F.col("available")).alias("rest"), (F.col("max_repeats") > rounds).alias("more"))
    fits = F.col("_before") + F.col("n_tokens") <= F.col("rest") + 1e-6
    both = placed.join(wanted, "source").groupBy("mix_name", "source").agg(F.max(F.when(fits & F.col("more"), F.col("_before") + F.col("n_tokens"))).alias("filled"))
    state = folder.write(wanted.join(both, ["mix_name", "source"], "left").withColumn("filled", F.coalesce("filled", F.lit(0))), "filled0")
    # In the order of the round the documents beyond those that fit.
    picks = "mix_name string, source string, _before bigint, _after bigint, n_tokens bigint"
    extra = placed.sparkSession.createDataFrame([], picks)
    for k in range(1, PASSES + 2):
        gap = F.col("rest") - F.col("filled")
        short = state.filter(F.col("more") & (gap > TOLERANCE * F.col("demand")))
        if short.isEmpty():
            break
        left = placed.join(short, "source").filter(~fits).join(extra.select("mix_name", "source", "_before"), ["mix_name", "source", "_before"], "left_anti")
        size, order = F.col("n_tokens").cast("bigint"), F.struct((-F.col("_before")).alias("b"))
        if k <= PASSES:
            best = F.max(F.when(size <= gap, F.struct(size.alias("n"), order.alias("o"))))
        else:
            best = F.max(F.when((size > gap) & (size < 2 * gap), F.struct((-size).alias("m"), order.alias("o"), size.alias("n"))))
        found = left.groupBy("mix_name", "source").agg(best.alias("x")).filter("x is not null").select("mix_name", "source", (-F.col("x.o.b")).cast("bigint").alias("_before"), F.col("x.n").alias("n_tokens"))
        found = folder.write(found.join(state.select("mix_name", "source", F.col("filled").cast("bigint").alias("_after")), ["mix_name", "source"]).select("mix_name", "source", "_before", "_after", "n_tokens"), f"extra{k}")
        if found.isEmpty():
            if k <= PASSES:
                continue
            break
        extra = extra.unionByName(found)
        state = folder.write(state.join(found.select("mix_name", "source", F.col("n_tokens").alias("_n")), ["mix_name", "source"], "left").withColumn("filled", F.col("filled") + F.coalesce("_n", F.lit(0))).drop("_n"), f"filled{k}")
    return state, extra


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total_tokens: float | None = None,
    tilt: float = 0.5,
    seed: int = 17,
    tokenizer: str = TOKENIZER,
    folder: RunFolder | None = None,
    schedules: DataFrame | None = None,
) -> Mix:
    """Copies of documents so that each source's share of a mix's tokens meets its target as far as it can.

    See ``plan_mix`` for demands and schedules and ``fill`` for how documents
    meet a demand. Documents without source or tokens are in no mix; sources
    without target are in none. Rows of one document count as documents of their
    own. ``tokenizer`` is a file that every executor must have under that path.
    """
    folder = folder or RunFolder(documents.sparkSession, "mix")
    named = documents.select(F.col(id_col).alias("doc_id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).filter("source is not null")
    wanted = clean_targets(targets)
    docs = folder.write(token_counts(named.join(wanted.select("source").distinct(), "source", "left_semi"), "text", ("doc_id", "source"), tokenizer).filter("n_tokens > 0"), "tokens")
    available = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    plan = folder.write(plan_mix(wanted, available, total_tokens, tilt, schedules), "plan")
    placed = folder.write(before_each(docs, "source", "n_tokens", "doc_id", seed).select("doc_id", "source", "n_tokens", "_before"), "placed")
    state, extra = fill(placed, plan, folder)
    facts = plan.select("mix_name", "source", "available", "pieces", "area").join(state.select("mix_name", "source", "demand", "rounds", "rest", "more"), ["mix_name", "source"])
    chosen = extra.select("mix_name", F.col("source"), "_before", "_after")
    joined = placed.join(facts, "source").join(chosen, ["mix_name", "source", "_before"], "left")
    last = F.col("more") & ((F.col("_before") + F.col("n_tokens") <= F.col("rest") + 1e-6) | F.col("_after").isNotNull())
    n = F.col("rounds") + last.cast("bigint")
    copies = joined.withColumn("_n", n).filter("_n > 0").withColumn("copy_no", F.explode(F.expr("sequence(1L, _n)")))
    # A copy's tokens before it: those of full rounds and those before it in its round.
    in_round = F.when((F.col("copy_no") > F.col("rounds")) & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_before"))
    offset = (F.col("copy_no") - 1) * F.col("available") + in_round
    at = position(offset / F.col("demand"), F.col("pieces"), F.col("area"))
    return Mix(copies.select("mix_name", "source", "doc_id", "copy_no", "n_tokens", at.alias("position")), plan.drop("pieces", "area"))
