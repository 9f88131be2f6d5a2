"""Overlapping procedures of several subjects: each event goes to the open attempt it fits best.

Profiles say by matchers what triggers an attempt, what its stages are and what
ends it. Matchers are compiled to Columns, so Python sees numbers only: a state
machine streams the events of a group (what shares identities, directly or
through others) in order, holding the open attempts. A group is cut where it is
silent for so long that every open attempt has expired; the pieces are
independent, so a group with a third of all events is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.operators.attempts import BLOCK, islands
from sigtrace.operators.match import EventMatcher, any_matcher
from sigtrace.operators.ordered import running, with_neighbour
from sigtrace.sources.shared import RunFolder


@dataclass(frozen=True)
class Stage:
    """A step of a procedure, found by its matchers; a terminal one decides the outcome."""

    stage_id: str
    order: int
    matchers: tuple[EventMatcher, ...]
    terminal: str | None = None  # succeeded or failed
    repeatable: bool = False


@dataclass(frozen=True)
class Procedure:
    """A profile: triggers, stages, terminals (tried in the order success, failure, abort) and how long it may be silent."""

    profile_id: str
    triggers: tuple[EventMatcher, ...]
    stages: tuple[Stage, ...] = ()
    success: tuple[EventMatcher, ...] = ()
    failure: tuple[EventMatcher, ...] = ()
    abort: tuple[EventMatcher, ...] = ()
    response_timeout: int = 10
    parents: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scoring:
    """Points of 100 for what an event and an attempt share, and the thresholds."""

    weights: dict = field(default_factory=lambda: {"ue": 35, "access": 25, "session": 20, "pdu": 15, "amf": 10, "ran": 10})
    in_order: int = 5
    trigger: int = 80
    initial_nas: int = 10
    with_session: int = 5
    least_trigger: int = 70
    least_assignment: int = 70
    same_attempt: int = 90
    idle_timeout: int = 30
    response_frames: int = 1000
    idle_frames: int = 2000


TERMINALS = ("succeeded", "failed", "aborted")
REASONS = {"succeeded": "success_terminal", "failed": "failure_terminal", "aborted": "abort_terminal"}
OUT = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("kind", T.StringType()), ("attempt_id", T.StringType()), ("profile_id", T.StringType()), ("event_id", T.StringType()), ("frame", T.LongType()), ("score", T.IntegerType()), ("reason", T.StringType()),
        ("ambiguous", T.BooleanType()), ("stage_id", T.StringType()), ("start_frame", T.LongType()), ("end_frame", T.LongType()), ("start_time", T.LongType()), ("end_time", T.LongType()), ("n_events", T.LongType()), ("outcome", T.StringType()), ("parent_id", T.StringType()),
        ("ue", T.StringType()), ("access", T.StringType()), ("session", T.StringType()),
    )]
)


@dataclass
class Segmented:
    """``attempts``, ``assignments`` (one row per event, without attempt if unassigned) and ``transitions`` (stages reached)."""

    attempts: DataFrame
    assignments: DataFrame
    transitions: DataFrame


def assign(events: DataFrame, procedures: list[Procedure], capture_end: Column | int | None = None, scoring: Scoring = Scoring(), folder: RunFolder | None = None) -> Segmented:
    """Attempts of overlapping subjects by several profiles.

    ``events`` have ``group``, ``seq`` (unique BIGINT that gives the order),
    ``event_id``, ``frame``, ``time`` (seconds, nullable), ``message_type``,
    ``protocol``, ``outcome``, what the matchers name, and the nullable
    identities ``ue, access, session, pdu, amf, ran``. Per event, in order:
    attempts silent beyond their response timeout or the idle one expire (counted
    in frames where a time is missing); of the profiles it triggers the greatest
    id opens an attempt, unless one of that profile is open that it fits as well
    as its own; it then belongs to the new attempt, else to the open one with
    most points (an attempt with another access context has none), ties to the
    greatest id and marked ambiguous; with too few points it stays unassigned.
    Its stages and terminals then decide whether the attempt ends. Attempts open
    at the end have timed out if ``capture_end`` (default: the last time) lies
    beyond their response timeout, else they are incomplete. An attempt's
    identities are those of its trigger. Events without a group are left out.
    """
    folder = folder or RunFolder(events.sparkSession, "procedures")
    profiles = sorted(procedures, key=lambda p: p.profile_id)
    if capture_end is None:
        capture_end = events.agg(F.max("time")).scalar()
    end_time = capture_end if isinstance(capture_end, Column) else F.lit(capture_end)
    listed = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in tests], F.lit(None).cast("int")))
    stages = [(i, k, st) for i, p in enumerate(profiles) for k, st in enumerate(sorted(p.stages, key=lambda s: (s.order, s.stage_id)))]
    ids = ["ue", "access", "session", "pdu", "amf", "ran"]
    e = events.filter("group is not null").select(
        F.col("group").cast("string").alias("group"), F.col("seq").cast("bigint").alias("seq"), F.col("event_id").cast("string").alias("event_id"), F.col("frame").cast("bigint").alias("frame"), F.col("time").cast("bigint").alias("time"),
        *[F.col(c).cast("string").alias(c) for c in ids], end_time.cast("bigint").alias("_end"),
        (F.col("message_type").startswith("INITIAL_") & (F.col("protocol") == "NAS")).alias("_initial"),
        listed([(i, any_matcher(list(p.triggers))) for i, p in enumerate(profiles)]).alias("_trigger"),
        listed([(n, any_matcher(list(st.matchers))) for n, (_, _, st) in enumerate(stages)]).alias("_stages"),
        listed([(3 * i + k, any_matcher(list(ms))) for i, p in enumerate(profiles) for k, ms in enumerate((p.success, p.failure, p.abort))]).alias("_ends"),
    )
    silent = max([min(p.response_timeout, scoring.idle_timeout) for p in profiles], default=scoring.idle_timeout)
    # Silence counts from the latest time so far; an attempt may hang on an event without a time for some frames.
    hidden = F.max, F.when(F.col("time").isNull(), F.col("frame"))
    e = running(e, ["group"], F.floor(F.col("seq") / BLOCK), ["seq"], {"_latest": (F.max, F.col("time")), "_hidden": hidden})
    e = e.withColumn("_clock", F.when(F.col("_hidden").isNull() | (F.col("frame") - F.col("_hidden") > min(scoring.response_frames, scoring.idle_frames)), F.col("_latest")))
    pieces = islands(e, ["group"], "seq", "_clock", silent, F.lit(False)).withColumnRenamed("attempt_no", "piece").drop("_latest", "_hidden", "_clock")
    # The first event of a piece is the clock that expires what the piece before it left open.
    first = pieces.groupBy("group", "piece").agg(F.min(F.struct("seq", "time", "frame")).alias("x")).select("group", (F.col("piece") - 1).alias("piece"), "x.*").filter("piece > 0")
    rows = pieces.withColumn("clock", F.lit(False)).unionByName(first.withColumn("clock", F.lit(True)), allowMissingColumns=True)
    ordered = rows.repartition("group", "piece").sortWithinPartitions("group", "piece", "seq")
    stage_of = [(i, st.stage_id, st.terminal, st.repeatable) for i, _, st in stages]
    w = scoring.weights

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[dict] = []
        now, end, out = None, None, []
        none = dict.fromkeys(OUT.names)

        def points(a: dict, x) -> int:
            if a["access"] is not None and x.access is not None and a["access"] != x.access:
                return 0
            total = sum(v for k, v in w.items() if a[k] is not None and a[k] == getattr(x, k))
            return min(total + (scoring.in_order if x.frame >= a["last"][0] else 0), 100)

        def close(a: dict, outcome: str, reason: str) -> None:
            open_.remove(a)
            out.append(none | {"kind": "attempt", "attempt_id": a["id"], "profile_id": profiles[a["p"]].profile_id, "event_id": a["first"][2], "frame": a["first"][0], "score": a["score"], "reason": reason, "ambiguous": a["ambiguous"],
                "start_frame": a["first"][0], "end_frame": a["last"][0], "start_time": a["first"][1], "end_time": a["last"][1], "n_events": a["n"], "outcome": outcome, "parent_id": a["parent"], "ue": a["ue"], "access": a["access"], "session": a["session"]})

        def overdue(a: dict, frame: int, time: int | None) -> str | None:
            if time is not None and a["last"][1] is not None:
                gone, limits = time - a["last"][1], (profiles[a["p"]].response_timeout, scoring.idle_timeout)
            else:
                gone, limits = frame - a["last"][0], (scoring.response_frames, scoring.idle_frames)
            return "response_timeout" if gone > limits[0] else "idle_timeout" if gone > limits[1] else None

        def finish() -> None:
            for a in list(open_):
                late = end is not None and a["last"][1] is not None and end - a["last"][1] > profiles[a["p"]].response_timeout
                close(a, "timed_out" if late else "incomplete_capture", "response_timeout" if late else "capture_ended_before_terminal")

        for f in frames:
            f = f.astype(object).where(f.notna(), None)
            for x in f.itertuples(index=False, name="Row"):
                if (x.group, x.piece) != now:
                    finish()
                    now = (x.group, x.piece)
                end = end if x.clock else x.end_
                for a in list(open_):
                    reason = overdue(a, x.frame, x.time)
                    if reason:
                        close(a, "timed_out", reason)
                if x.clock:
                    continue
                new = None
                if len(x.trigger):
                    p = max(int(i) for i in x.trigger)
                    score = min(scoring.trigger + (scoring.initial_nas if x.initial else 0) + (scoring.with_session if x.pdu is not None else 0), 100)
                    if score >= scoring.least_trigger and not any(a["p"] == p and points(a, x) >= scoring.same_attempt for a in open_):
                        inside = [a for a in open_ if profiles[a["p"]].profile_id in profiles[p].parents and all(a[k] is None or getattr(x, k) is None or a[k] == getattr(x, k) for k in ("ue", "session", "access"))]
                        parent = max(inside, key=lambda a: (a["first"][0], a["id"]))["id"] if inside else None
                        new = {"id": f"{profiles[p].profile_id}:{x.event_id}", "p": p, "score": score, "first": (x.frame, x.time, x.event_id), "last": (x.frame, x.time), "n": 0, "seen": set(), "parent": parent, "ambiguous": len(x.trigger) > 1} | {k: getattr(x, k) for k in ids}
                        open_.append(new)
                said = none | {"kind": "event", "event_id": x.event_id, "frame": x.frame, "ambiguous": False}
                if new is not None:
                    to, said["score"], said["reason"] = new, new["score"], "trigger"
                else:
                    ranked = sorted(((points(a, x), a["id"], a) for a in open_), key=lambda r: r[:2], reverse=True)
                    if not ranked or ranked[0][0] < scoring.least_assignment:
                        out.append(said | {"score": ranked[0][0] if ranked else None, "reason": "below_threshold" if ranked else "no_open_attempt"})
                        continue
                    said["score"], to = ranked[0][0], ranked[0][2]
                    said["ambiguous"], said["reason"] = len(ranked) > 1 and ranked[1][0] == ranked[0][0], "best_score"
                out.append(said | {"attempt_id": to["id"], "profile_id": profiles[to["p"]].profile_id})
                to["last"], to["n"] = (x.frame, x.time), to["n"] + 1
                outcome = reason = None
                for i in x.stages:
                    p, stage, terminal, again = stage_of[int(i)]
                    if p != to["p"] or stage in to["seen"] and not again:
                        continue
                    to["seen"].add(stage)
                    out.append(none | {"kind": "stage", "attempt_id": to["id"], "profile_id": profiles[p].profile_id, "event_id": x.event_id, "frame": x.frame, "stage_id": stage})
                    if terminal:
                        outcome, reason = terminal, f"stage:{stage}"
                if outcome is None:
                    hits = [int(i) % 3 for i in x.ends if int(i) // 3 == to["p"]]
                    if hits:
                        outcome = TERMINALS[min(hits)]
                        reason = REASONS[outcome]
                if outcome:
                    close(to, outcome, reason)
            if out:
                yield pd.DataFrame(out, columns=OUT.names)
                out = []
        finish()
        if out:
            yield pd.DataFrame(out, columns=OUT.names)

    plain = ordered.withColumnsRenamed({"_trigger": "trigger", "_stages": "stages", "_ends": "ends", "_initial": "initial", "_end": "end_"})
    found = folder.write(plain.mapInPandas(run, OUT), "segmented")
    attempts = found.filter("kind = 'attempt'").select("attempt_id", "profile_id", F.col("event_id").alias("trigger_event_id"), "start_frame", "end_frame", "start_time", "end_time", "n_events", "outcome", "reason", F.col("score").alias("trigger_score"), F.col("ambiguous").alias("profile_ambiguous"), "parent_id", "ue", "access", "session")
    assignments = found.filter("kind = 'event'").select("event_id", "frame", "attempt_id", "profile_id", "score", "reason", "ambiguous")
    return Segmented(attempts, assignments, found.filter("kind = 'stage'").select("attempt_id", "profile_id", "stage_id", "event_id", "frame"))


def nearest_prior(attempts: DataFrame, current: list[str], prior: list[str], relation: str, other_access: bool = False, block: int = 1 << 16) -> DataFrame:
    """``left_attempt_id, right_attempt_id, relation``: to each attempt of the profiles ``current`` the one of ``prior`` of the same ``ue``
    that began before it (at the same frame: has the smaller id) and ended last (then began last, then has the greatest id); with
    ``other_access`` of those with another access context.

    Running maxima over blocks of frames, no range join: the best so far, and
    the best whose access differs from that one's. Whenever the best changes to
    another access, the one before it is the best of all others, so both are
    plain maxima. Attempts without ``ue``, or without access where it counts, have none.
    """
    a = attempts.filter("ue is not null")
    a = a.filter("access is not null") if other_access else a
    fact = F.struct(F.col("end_frame").alias("e"), F.col("start_frame").alias("s"), F.col("attempt_id").alias("id"), F.col("access").alias("a"))
    f = a.filter(F.col("profile_id").isin(prior)).select("ue", "start_frame", F.lit(1).alias("_is_fact"), "attempt_id", fact.alias("_f"), F.lit(None).cast("string").alias("_mine"))
    p = a.filter(F.col("profile_id").isin(current)).select("ue", "start_frame", F.lit(0).alias("_is_fact"), "attempt_id", F.lit(None).cast(f.schema["_f"].dataType).alias("_f"), F.col("access").alias("_mine"))
    both, order, at = f.unionByName(p), ["start_frame", "attempt_id", "_is_fact"], F.floor(F.col("start_frame") / block)
    best = running(both, ["ue"], at, order, {"_best": (F.max, F.col("_f"))})
    if other_access:
        # Of a fact that becomes the best the one it replaces counts for the others, of any other fact itself if its access differs.
        best = with_neighbour(best, ["ue"], at, order, F.col("_best"), "_was")
        second = F.when(F.col("_was.a") != F.col("_best.a"), F.col("_was")).when((F.col("_is_fact") == 1) & (F.col("_f.a") != F.col("_best.a")), F.col("_f"))
        best = running(best, ["ue"], at, order, {"_second": (F.max, second)})
        best = best.withColumn("_best", F.when(F.col("_best.a") != F.col("_mine"), F.col("_best")).otherwise(F.col("_second")))
    return best.filter("_is_fact = 0 and _best is not null").select(F.col("attempt_id").alias("left_attempt_id"), F.col("_best.id").alias("right_attempt_id"), F.lit(relation).alias("relation"))
