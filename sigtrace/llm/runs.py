"""Runs of near-identical consecutive events as one event each, by optimal segmentation.

An event has one or more fields, each with a weight. The segmentation of each
entity's sequence minimises

    sum over fields of weight * (events that differ from their run's most frequent value)
    + penalty * (number of runs)

by pruned dynamic programming. The dissimilarity of a run is never less than
that of its parts, so a start that is no cheaper than a later cut can never win
again and is pruned; few candidate starts stay alive, and the work is linear in
practice. Runs before the last point that all live candidates share are given
out at once, so a long sequence is not held.

Sequences are cut over tasks by range of (entity, order), so one with a third of
all rows is spread. A cut between two unmixed stretches is *safe* if splitting
either of them off saves more than two penalties: every optimal segmentation has
it, whatever lies beyond. A task streams its rows as stretches, solves what lies
between its safe cuts, and leaves what lies outside of the first and last safe
cut of a sequence that may go on in another task to a second pass, where it is
stitched to its neighbours. If every weight is more than twice the penalty, every
change of event is safe, and the second pass holds two stretches a task. The
number of ranges follows from the size of the input, so a task's part is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.sources.shared import RunFolder

RANGE_BYTES = 64 << 20  # of the written input in one range
LOOK_BACK = 4096  # pending stretches from which on what is settled is given out


class Segmenter:
    """The dynamic program over stretches ``(codes, n)``, one code per field; gives out settled runs as (from, to) places.

    None as a code is like no other value. Of equal costs the run that begins
    first among the live candidates wins, so the result is determined.
    """

    def __init__(self, penalty: float, weights: tuple[float, ...]):
        self.penalty, self.weights = penalty, weights
        self.unique = count()
        self.start()

    def start(self) -> None:
        self.base = 0  # place of the first stretch not given out
        self.best, self.back = [0.0], [0]  # from the base on
        self.alive: list[list] = []  # [start, per field counts, per field highest, events, cost at the start, cost now]

    def push(self, codes: tuple, n: int) -> None:
        t = len(self.best) - 1
        self.alive.append([t, [{} for _ in codes], [0] * len(codes), 0, self.best[t], 0.0])
        keys = [("like no other", next(self.unique)) if c is None else c for c in codes]
        low, at = float("inf"), t
        for c in self.alive:
            c[3] += n
            cost = c[4]
            for i, key in enumerate(keys):
                m = c[1][i][key] = c[1][i].get(key, 0) + n
                if m > c[2][i]:
                    c[2][i] = m
                cost += self.weights[i] * (c[3] - c[2][i])
            c[5] = cost
            if cost < low:
                low, at = cost, c[0]
        low += self.penalty
        self.best.append(low)
        self.back.append(at)
        self.alive = [c for c in self.alive if c[5] < low]

    def _path(self, t: int) -> list[int]:
        out = []
        while t:
            out.append(t)
            t = self.back[t]
        return out[::-1]

    def settled(self) -> list[tuple[int, int]]:
        """Runs that whatever follows can't change: before the last cut common to all live candidates."""
        paths = [self._path(c[0]) for c in self.alive] + [self._path(len(self.best) - 1)]
        common = 0
        for cuts in zip(*paths):
            if any(x != cuts[0] for x in cuts):
                break
            common = cuts[0]
        if not common:
            return []
        out = self._runs(common)
        self.best = self.best[common:]
        self.back = [0, *[max(b - common, 0) for b in self.back[common + 1 :]]]
        for c in self.alive:
            c[0] -= common
        self.base += common
        return out

    def _runs(self, end: int) -> list[tuple[int, int]]:
        cuts = [0, *self._path(end)]
        return [(self.base + a, self.base + b) for a, b in zip(cuts, cuts[1:])]

    def finish(self) -> list[tuple[int, int]]:
        out = self._runs(len(self.best) - 1)
        self.start()
        return out


def segment(codes: list, weights: list[int] | None, penalty: float, mismatch: float | tuple[float, ...]) -> list[int]:
    """The starts of the optimal runs of a sequence of codes (tuples if ``mismatch`` has a weight per field).

    ``weights`` are the numbers of equal events each code stands for.
    """
    fields = mismatch if isinstance(mismatch, tuple) else (mismatch,)
    s = Segmenter(penalty, fields)
    out = []
    for i, c in enumerate(codes):
        s.push(c if isinstance(mismatch, tuple) else (c,), 1 if weights is None else weights[i])
        if len(s.best) > LOOK_BACK and len(s.best) % LOOK_BACK == 0:
            out += s.settled()
    return [a for a, _ in [*out, *(s.finish() if codes else [])]]


def safe_cuts(codes: list[tuple], sizes: np.ndarray, penalty: float, weights: tuple[float, ...]) -> np.ndarray:
    """Which stretches begin at a safe cut from the one before: splitting either off saves more than two penalties.

    In each field in which both differ at least one of them is unlike the rest
    of a run over the cut, so the least weight of such a field counts.
    """
    safe = np.zeros(len(codes), bool)
    for i in range(1, len(codes)):
        a, b = codes[i - 1], codes[i]
        least = min((w for x, y, w in zip(a, b, weights) if x is None or y is None or x != y), default=0.0)
        safe[i] = least * min(sizes[i - 1], sizes[i]) > 2 * penalty
    return safe


HEAD, TAIL, DONE = "head", "tail", "done"


def collapse_runs(
    df: DataFrame,
    entity: list[str],
    order: list[str],
    event: str | dict[str, float],
    time: str,
    carry: list[str],
    penalty: float = 0.25,
    mismatch: float = 1.0,
    folder: RunFolder | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per run: ``entity``, the event's fields (the most frequent values of the run), ``n_events``, ``n_unlike``
    (events that differ from these in any field), ``duration``, ``first_time``, ``last_time`` and the ``carry`` columns
    of its first and last event as ``first_x``, ``last_x``.

    ``event`` names a STRING column, or several with the weight of a difference
    in each; nulls are like no other value. ``order`` columns are sorted
    ascending, nulls first; rows that tie in all of them are taken in the order
    of event and carried columns, so repeated rows do no harm. ``time`` is
    numeric. Null entity values equal each other. An empty table gives an empty
    one. The input is written once, and the number of ``ranges`` follows from
    its size (RANGE_BYTES each, at least the session's shuffle partitions).
    """
    weighted = event if isinstance(event, dict) else {event: mismatch}
    weights = tuple(float(w) for w in weighted.values())
    if not weights or min(weights) <= 0 or penalty <= 0:
        raise ValueError("penalty and weights must be positive")
    spark = df.sparkSession
    folder = folder or RunFolder(spark, "runs")
    carry = list(dict.fromkeys(carry))
    named = {f"e{i}": c for i, c in enumerate(entity)} | {f"o{i}": c for i, c in enumerate(order)} | {f"c{i}": c for i, c in enumerate(carry)}
    source = df.select(*[F.col(c).alias(k) for k, c in named.items()], *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(weighted)], F.col(time).alias("time"))
    es, os_, cs, fs = [f"e{i}" for i in range(len(entity))], [f"o{i}" for i in range(len(order))], [f"c{i}" for i in range(len(carry))], [f"f{i}" for i in range(len(weights))]
    source = folder.write(source, "events")
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-folder.size("events") // RANGE_BYTES))
    keys = [F.col(c).asc_nulls_first() for c in [*es, *os_, *fs, *cs]]
    ranged = source.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    typ = {f.name: f.dataType for f in source.schema}
    ends = [*os_, "time", *cs]
    schema = T.StructType(
        [T.StructField("place", T.StringType()), *[T.StructField(c, typ[c]) for c in es], *[T.StructField(c, T.StringType()) for c in fs], T.StructField("n", T.LongType()), T.StructField("unlike", T.LongType())]
        + [T.StructField(f"{side}_{c}", typ[c]) for side in ("first", "last") for c in ends]
    )
    inner = [c for c in schema.names if c != "place"]

    def ids_of(table: pa.Table, names: list[str]) -> list[np.ndarray]:
        out = []
        for c in names:
            col = table.column(c).combine_chunks()
            if isinstance(col, pa.ChunkedArray):
                col = pa.concat_arrays(col.chunks)
            out.append(col.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False))
        return out

    def changes(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for x in ids_of(table, es):
            new[1:] |= x[1:] != x[:-1]
        return new

    def to_stretches(table: pa.Table) -> pa.Table:
        new = changes(table)
        for x in ids_of(table, fs):
            new[1:] |= (x[1:] != x[:-1]) | (x[1:] < 0)
        starts = np.flatnonzero(new)
        stops = np.r_[starts[1:], table.num_rows] - 1
        a, z = table.take(pa.array(starts)), table.take(pa.array(stops))
        cols = {c: a.column(c) for c in [*es, *fs]} | {"n": pa.array(stops - starts + 1, pa.int64()), "unlike": pa.array(np.zeros(len(starts), np.int64))}
        return pa.table(cols | {f"first_{c}": a.column(c) for c in ends} | {f"last_{c}": z.column(c) for c in ends})

    def joined(held: pa.Table | None, more: pa.Table) -> pa.Table:
        """One table, with the last stretch held and the first one new put together if they are one."""
        if held is None or not held.num_rows:
            return more
        last, first = held.slice(held.num_rows - 1).to_pylist()[0], more.slice(0, 1).to_pylist()[0]
        if any(last[c] != first[c] for c in es) or any(last[c] is None or last[c] != first[c] for c in fs):
            return pa.concat_tables([held, more])
        tail, head = held.slice(held.num_rows - 1), more.slice(0, 1)
        one = {c: tail.column(c) for c in [*es, *fs, "unlike"]} | {"n": pa.array([last["n"] + first["n"]], pa.int64())}
        one |= {f"first_{c}": tail.column(f"first_{c}") for c in ends} | {f"last_{c}": head.column(f"last_{c}") for c in ends}
        return pa.concat_tables([held.slice(0, held.num_rows - 1), pa.table(one).select(inner), more.slice(1)])

    def codes_of(table: pa.Table) -> list[tuple]:
        return list(zip(*[table.column(c).to_pylist() for c in fs]))

    def marked(table: pa.Table, place: str) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            yield from table.add_column(0, "place", pa.array([place] * table.num_rows, pa.string())).select(schema.names).combine_chunks().to_batches()

    def as_runs(table: pa.Table, runs: list[tuple[int, int]], codes: list[tuple], sizes: np.ndarray) -> pa.Table:
        """The stretches from ``a`` to ``b`` of each run as one row."""
        if all(b - a == 1 for a, b in runs):
            return table.take(pa.array([a for a, _ in runs], pa.int64())) if len(runs) < table.num_rows else table
        usual: list[list] = [[] for _ in fs]
        n, unlike = [], []
        for a, b in runs:
            counts: list[dict] = [{} for _ in fs]
            for i in range(a, b):
                for c, code in zip(counts, codes[i]):
                    if code is not None:
                        c[code] = c.get(code, 0) + int(sizes[i])
            top = tuple(min(c, key=lambda k, c=c: (-c[k], k)) if c else None for c in counts)
            for u, t in zip(usual, top):
                u.append(t)
            n.append(int(sizes[a:b].sum()))
            unlike.append(sum(int(sizes[i]) for i in range(a, b) if any(x != t for x, t in zip(codes[i], top))) if b - a > 1 else 0)
        f, z = table.take(pa.array([a for a, _ in runs], pa.int64())), table.take(pa.array([b - 1 for _, b in runs], pa.int64()))
        cols = {c: f.column(c) for c in es} | {c: pa.array(u, pa.string()) for c, u in zip(fs, usual)} | {"n": pa.array(n, pa.int64()), "unlike": pa.array(unlike, pa.int64())}
        return pa.table(cols | {f"first_{c}": f.column(f"first_{c}") for c in ends} | {f"last_{c}": z.column(f"last_{c}") for c in ends}).select(inner)

    def solve(table: pa.Table, codes: list[tuple], sizes: np.ndarray, pieces: list[tuple[int, int]]) -> pa.Table:
        """The optimal runs of pieces between safe cuts."""
        runs: list[tuple[int, int]] = []
        for a, b in pieces:
            if b - a == 1:
                runs.append((a, b))
                continue
            starts = segment(codes[a:b], [int(x) for x in sizes[a:b]], penalty, weights)
            runs += [(a + x, a + y) for x, y in zip(starts, [*starts[1:], b - a])]
        return as_runs(table, runs, codes, sizes)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        in_head = True  # before the first safe cut of the task's first entity

        def step(table: pa.Table, over: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, in_head
            codes, sizes = codes_of(table), table.column("n").to_numpy()
            new = changes(table)
            safe = safe_cuts(codes, sizes, penalty, weights)
            safe[new] = False
            bounds = [*np.flatnonzero(new).tolist(), table.num_rows]
            pieces: list[tuple[int, int]] = []
            keep = table.num_rows
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                cuts = (a + np.flatnonzero(safe[a:b])).tolist()
                last = k == len(bounds) - 2
                if in_head:
                    stop = cuts[0] if cuts else b - 1 if last and not over else b  # the last stretch may still grow
                    yield from marked(table.slice(a, stop - a), HEAD)
                    if not cuts:
                        keep, in_head = (stop, True) if last else (keep, False)
                        continue
                    in_head, a = False, cuts.pop(0)
                if last:
                    keep = cuts[-1] if cuts else a
                    pieces += list(zip([a, *cuts[:-1]], cuts)) if cuts else []
                else:
                    pieces += list(zip([a, *cuts], [*cuts, b]))
            if pieces:
                yield from marked(solve(table, codes, sizes, pieces), DONE)
            held = table.slice(keep)

        for b in batches:
            if b.num_rows:
                yield from step(joined(held, to_stretches(pa.Table.from_batches([b])).select(inner)), False)
        if held is not None and held.num_rows:
            yield from marked(held, HEAD if in_head else TAIL)

    solved = folder.write(ranged.mapInArrow(first_pass, schema), "solved")
    done, open_ = solved.filter(F.col("place") == DONE), solved.filter(F.col("place") != DONE)
    by = [F.col(f"first_{c}").asc_nulls_first() for c in os_] + [F.col(c).asc_nulls_first() for c in fs] + [F.col(f"first_{c}").asc_nulls_first() for c in cs]
    sorted_open = open_.repartition(*es).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in es], *by)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All unsolved stretches of an entity in order.

        They connect, but for the solved part between a task's head and its
        tail: a tail after a head begins a problem of its own. What the program
        has settled is given out as it goes.
        """
        work = Segmenter(penalty, weights)
        held, last = None, None  # stretches pushed and not given out; the last row's entity and place

        def out(runs: list[tuple[int, int]], base: int) -> Iterator[pa.RecordBatch]:
            if runs:
                yield from marked(as_runs(held, [(a - base, b - base) for a, b in runs], codes_of(held), held.column("n").to_numpy()), DONE)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            places, codes, sizes = table.column("place").to_pylist(), codes_of(table), table.column("n").to_pylist()
            owners = list(zip(*[table.column(c).to_pylist() for c in es])) if es else [()] * len(places)
            table, at = table.select(inner), 0
            for i, (place, owner) in enumerate(zip(places, owners)):
                if last is not None and (owner != last[0] or place == TAIL and last[1] == HEAD):
                    held = pa.concat_tables([held, table.slice(at, i - at)]) if held is not None else table.slice(at, i - at)
                    base, at = work.base, i
                    yield from out(work.finish(), base)
                    held = None
                work.push(codes[i], sizes[i])
                last = (owner, place)
            held = pa.concat_tables([held, table.slice(at)]).combine_chunks() if held is not None else table.slice(at)
            if len(work.best) > LOOK_BACK:
                base = work.base
                runs = work.settled()
                yield from out(runs, base)
                held = held.slice(work.base - base)
        if held is not None and held.num_rows:
            base = work.base
            yield from out(work.finish(), base)

    runs = done.unionByName(sorted_open.mapInArrow(stitch, schema))
    return runs.select(
        *[F.col(e).alias(c) for e, c in zip(es, entity)],
        *[F.col(f).alias(c) for f, c in zip(fs, weighted)],
        F.col("n").alias("n_events"),
        F.col("unlike").alias("n_unlike"),
        (F.col("last_time") - F.col("first_time")).alias("duration"),
        "first_time",
        "last_time",
        *[F.col(f"{side}_{k}").alias(f"{side}_{c}") for side in ("first", "last") for k, c in zip(cs, carry) if c != time],
    )
