"""Stages of attempts as a DAG, deadlines, orderings, scenarios and request fields, compiled to Columns.

What a profile or scenario says is known on the driver and small, so it becomes
expressions over one aggregate per attempt; nothing loops over attempts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrace.functions.text import holds_tokens
from sigtrace.operators.match import condition
from sigtrace.operators.ordered import running
from sigtrace.operators.transactions import earliest, state_of


@dataclass(frozen=True)
class StageRule:
    """A stage that an attempt should reach: ``applicability`` is mandatory, conditional or optional."""

    stage_id: str
    order: int
    applicability: str = "mandatory"
    predecessors: tuple[str, ...] = ()
    condition: dict | None = None
    timeout: int | None = None
    visible: tuple[str, ...] = ()  # boolean columns of the attempt that must be true
    terminal_success: bool = False


def check_dag(rules: list[StageRule]) -> list[StageRule]:
    """The rules in their order; raises if a predecessor is unknown, stands behind its stage, or ids repeat."""
    ordered = sorted(rules, key=lambda r: (r.order, r.stage_id))
    before: set[str] = set()
    for r in ordered:
        if r.stage_id in before or not set(r.predecessors) <= before:
            raise ValueError(f"stage {r.stage_id}: repeated, or a predecessor that is not before it")
        before.add(r.stage_id)
    return ordered


def stage_results(attempts: DataFrame, seen: DataFrame, rules: list[StageRule], by: list[str], facts: dict[str, Column], explained: DataFrame | None = None, requested: DataFrame | None = None) -> DataFrame:
    """``by, stage_id, stage_no, state, reason, first_frame, last_frame, deadline``: what became of each stage of each attempt.

    ``attempts`` have ``by``, ``start_time``, ``incomplete_history`` and what
    facts and visibility name; ``seen`` has ``by, stage_id, frame, time``;
    ``explained`` and ``requested`` have ``by, stage_id`` of stages with an
    explicit failure, and with a request that nobody answered. In the order of
    the rules a stage is completed if it was seen (reason ``deadline_missed`` if
    its last event is later than its deadline); else skipped if its condition is
    false or unknown, a predecessor is not completed, it is optional, it was not
    visible or the history is incomplete; else suppressed if it is explained, or
    requested and no terminal success; else missing. The deadline is the timeout
    after the latest predecessor (after the start without any).
    """
    ordered = check_dag(rules)
    mine = lambda r, c: F.when(F.col("stage_id") == r.stage_id, F.col(c))
    aggs = [x for i, r in enumerate(ordered) for x in (F.min(mine(r, "frame")).alias(f"_f{i}"), F.max(mine(r, "frame")).alias(f"_l{i}"), F.max(mine(r, "time")).alias(f"_t{i}"))]
    g = attempts.join(seen.groupBy(*by).agg(*aggs), by, "left")
    for name, df in (("_x", explained), ("_r", requested)):
        if df is None:
            g = g.withColumns({f"{name}{i}": F.lit(False) for i in range(len(ordered))})
        else:
            g = g.join(df.groupBy(*by).agg(*[F.coalesce(F.bool_or(F.col("stage_id") == r.stage_id), F.lit(False)).alias(f"{name}{i}") for i, r in enumerate(ordered)]), by, "left")
    place = {r.stage_id: i for i, r in enumerate(ordered)}
    deadlines: dict[str, Column] = {}
    for i, r in enumerate(ordered):
        applies = condition(r.condition, facts) if r.condition else F.lit(True)
        blocked = reduce(lambda a, b: a | b, [F.col(f"_s{place[p]}.state") != "completed" for p in r.predecessors], F.lit(False))
        hidden = ~reduce(lambda a, b: a & b, [F.coalesce(F.col(v), F.lit(False)) for v in r.visible], F.lit(True))
        anchor = F.greatest(*[F.col(f"_t{place[p]}") for p in r.predecessors], F.lit(None)) if r.predecessors else F.col("start_time")
        deadlines[r.stage_id] = (anchor + r.timeout) if r.timeout is not None else F.lit(None).cast("bigint")
        as_ = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
        state = (
            F.when(F.col(f"_f{i}").isNotNull() & F.coalesce(F.col(f"_t{i}") > deadlines[r.stage_id], F.lit(False)), as_("completed", "deadline_missed"))
            .when(F.col(f"_f{i}").isNotNull(), as_("completed", "observed_stage"))
            .when(applies.isNull(), as_("skipped", "fact_unknown"))
            .when(~applies, as_("skipped", "condition_false"))
            .when(blocked, as_("skipped", "predecessor_not_reached"))
            .when(F.lit(r.applicability == "optional"), as_("skipped", "optional_stage"))
            .when(hidden, as_("skipped", "not_visible"))
            .when(F.coalesce("incomplete_history", F.lit(False)), as_("skipped", "history_incomplete"))
            .when(F.coalesce(f"_x{i}", F.lit(False)), as_("suppressed", "explicit_evidence"))
            .when(F.coalesce(f"_r{i}", F.lit(False)) & F.lit(not r.terminal_success), as_("suppressed", "request_only"))
            .otherwise(as_("missing", "required_stage"))
        )
        g = g.withColumn(f"_s{i}", state)
    each = [F.struct(F.lit(r.stage_id).alias("stage_id"), F.lit(i).alias("stage_no"), F.col(f"_s{i}.state").alias("state"), F.col(f"_s{i}.reason").alias("reason"), F.col(f"_f{i}").alias("first_frame"), F.col(f"_l{i}").alias("last_frame"), deadlines[r.stage_id].cast("bigint").alias("deadline")) for i, r in enumerate(ordered)]
    return g.select(*by, F.explode(F.array(*each)).alias("s")).select(*by, "s.*")


@dataclass(frozen=True)
class Ordering:
    """A demand on two checkpoints' first frames: ``form`` is before, immediately_before, at_least_n_between or no_forbidden_between."""

    name: str
    form: str
    first: str
    second: str
    n: int = 0
    forbidden: tuple[str, ...] = ()


def orderings(observed: DataFrame, by: list[str], demands: list[Ordering]) -> DataFrame:
    """``by, name, verdict``: whether each group of ``observed`` (``by, checkpoint, frame``) meets each demand.

    Null where one of the two checkpoints is missing. Between means strictly
    between the two first frames: for immediately_before no other checkpoint's
    first frame may lie there, for the others events of any checkpoint count.
    Two aggregates per group, one join; no event list is kept.
    """
    names = sorted({c for d in demands for c in (d.first, d.second)})
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    firsts = observed.groupBy(*by).agg(*[F.min(F.when(F.col("checkpoint") == c, F.col("frame"))).alias(a) for c, a in at.items()])
    firsts_of_all = observed.groupBy(*by, "checkpoint").agg(F.min("frame").alias("_first"))
    o = observed.select(*by, "checkpoint", "frame").join(firsts_of_all, [*by, "checkpoint"]).join(firsts, by)
    between = lambda d, c: (F.col(c) > F.col(at[d.first])) & (F.col(c) < F.col(at[d.second]))
    counts = []
    for i, d in enumerate(demands):
        test = between(d, "_first") if d.form == "immediately_before" else between(d, "frame")
        if d.form == "no_forbidden_between":
            test = test & F.col("checkpoint").isin(*d.forbidden)
        counts.append(F.count_if(test).alias(f"_n{i}"))
    g = o.groupBy(*by, *at.values()).agg(*counts)
    rows = []
    for i, d in enumerate(demands):
        before, n = F.col(at[d.first]) < F.col(at[d.second]), F.col(f"_n{i}")
        ok = {"before": before, "immediately_before": before & (n == 0), "at_least_n_between": before & (n >= d.n), "no_forbidden_between": before & (n == 0)}[d.form]
        rows.append(F.struct(F.lit(d.name).alias("name"), F.when(before.isNotNull(), ok).alias("verdict")))
    return g.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


@dataclass(frozen=True)
class Checkpoint:
    """What a scenario expects to see, or not: words of the message, a protocol, tests of fields, a scope of frames."""

    scenario: str
    name: str
    protocol: str | None = None
    message: str | None = None  # all of its words must stand in the observed message
    fields: tuple[tuple[str, str, object], ...] = ()  # (field, eq ne in present absent, value)
    frames: tuple[int, int] | None = None
    forbidden: bool = False


def fits(c: Checkpoint) -> Column:
    """Whether an observation is what the checkpoint describes, within its scope."""
    tests = [F.lit(True)]
    if c.protocol is not None:
        tests.append(F.col("protocol") == c.protocol)
    if c.message is not None:
        tests.append(holds_tokens(F.lit(c.message), F.col("message_type")))
    if c.frames is not None:
        tests.append(F.col("frame").between(*c.frames))
    for name, op, value in c.fields:
        f = F.col(name)
        tests.append({"eq": lambda: f == F.lit(value), "ne": lambda: f != F.lit(value), "in": lambda: f.isin(*value), "present": lambda: f.isNotNull() & (f.cast("string") != ""), "absent": lambda: f.isNull() | (f.cast("string") == "")}[op]())
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def checkpoint_verdicts(observations: DataFrame, checkpoints: list[Checkpoint], by: list[str], visible: Column | None = None, value: str | None = None) -> DataFrame:
    """``by, scenario, name, n_found, first_frame, verdict``: each checkpoint in each group of observations.

    Found is passed (failed if forbidden); not found is failed (passed if
    forbidden) only where ``visible`` is true for all of the group's
    observations, else inconclusive. With ``value``, found with more than one
    value of that column is inconclusive. One pass and one aggregate.
    """
    seen = F.coalesce(F.bool_and(visible if visible is not None else F.lit(True)), F.lit(False)).alias("_visible")
    aggs = []
    for i, c in enumerate(checkpoints):
        hit = fits(c)
        aggs += [F.count_if(hit).alias(f"_n{i}"), F.min(F.when(hit, F.col("frame"))).alias(f"_f{i}")]
        aggs.append((F.max(F.when(hit, F.col(value))) != F.min(F.when(hit, F.col(value)))).alias(f"_v{i}") if value else F.lit(False).alias(f"_v{i}"))
    g = observations.groupBy(*by).agg(seen, *aggs)
    rows = []
    for i, c in enumerate(checkpoints):
        there, conflict = F.col(f"_n{i}") > 0, F.coalesce(f"_v{i}", F.lit(False))
        verdict = F.when(there & conflict, "inconclusive").when(there, "failed" if c.forbidden else "passed").when(F.col("_visible"), "passed" if c.forbidden else "failed").otherwise("inconclusive")
        rows.append(F.struct(F.lit(c.scenario).alias("scenario"), F.lit(c.name).alias("name"), F.col(f"_n{i}").alias("n_found"), F.col(f"_f{i}").alias("first_frame"), verdict.alias("verdict")))
    return g.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def fold_verdicts(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """One status per scenario: failed if any checkpoint failed, else inconclusive if any is, else passed."""
    has = lambda v: F.bool_or(F.col("verdict") == v)
    status = F.when(has("failed"), "failed").when(has("inconclusive"), "inconclusive").otherwise("passed")
    return verdicts.groupBy(*by, "scenario").agg(status.alias("status"), F.count_if(F.col("verdict") == "failed").alias("n_failed"), F.count("*").alias("n_checkpoints"))


def request_fields(events: DataFrame, by: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """``by, field, value, n_values, status``: of each field the first value in order; decoded, conflict (several values) or missing."""
    one = F.struct
    aggs = [one(F.lit(f).alias("field"), earliest(F.col(f).cast("string"), *[F.col(o) for o in order]).alias("value"), F.count_distinct(F.col(f)).alias("n_values")).alias(f"_{i}") for i, f in enumerate(fields)]
    g = events.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*[f"_{i}" for i in range(len(fields))])).alias("x")).select(*by, "x.*")
    status = state_of({"missing": F.col("n_values") == 0, "conflict": F.col("n_values") > 1})
    return g.withColumn("status", F.when(status == "success", "decoded").otherwise(status))


def merged_sets(rows: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """``key, field, value``: the union of each array column over all rows of a key, one row per distinct value.

    In long form, so a key with a third of all rows is no single array.
    """
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("field"), F.col(s).cast("array<string>").alias("v")) for s in sets])).alias("x"))
    return long.select(key, "x.field", F.explode("x.v").alias("value")).filter("value is not null").distinct()


def with_earlier(events: DataFrame, by: list[str], order: str, found: Column, to: str, block: int = 1 << 16) -> DataFrame:
    """``to``: whether ``found`` held for an earlier event of the group (by ``order``, a unique integer)."""
    n = F.coalesce(found.cast("int"), F.lit(0))
    e = running(events.withColumn("_n", n), by, F.floor(F.col(order) / block), [order], {"_so_far": (F.sum, F.col("_n"))})
    return e.withColumn(to, F.col("_so_far") - F.col("_n") > 0).drop("_n", "_so_far")
