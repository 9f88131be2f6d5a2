"""Messages delivered at least once: exactly one copy of each is kept.

A Structured Streaming query holds the identifiers seen so far in Spark's state
store, which is committed together with the output of each micro-batch. The
identifiers are kept by hash bucket: a bucket's state is one array of 128-bit
fingerprints with the best copy of each, merged with numpy, as one state row per
identifier would cost a Python call each. An identifier leaves the state when
nothing of it was received since the watermark; what has left stays in a Bloom
filter of the bucket. The log of each batch has an entry for each kept row, each
dropped row and each kept row that a better copy replaced. An identifier that is
new to the state but in the filter may have come back: such entries alone are
looked up in what was kept before, so the result is exact however late a copy
comes, and a run costs as much as its new rows and not as all that ever was.

Copies are first reduced to one per identifier within each task, and the rest is
spread over all buckets by row, so an identifier with a third of all rows stays
small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.operators.dedup import key_hashes, key_text
from sigtrace.sources.shared import RunFolder

LAST = np.iinfo(np.int64).max  # stands for a null time or id: after all others
FIELDS = ("h1", "h2", "t", "id")
COMBINE_ROWS = 1 << 18
LEAST_BUCKETS, BUCKETS_A_CORE = 256, 32
BATCH_BYTES_A_CORE = 32 << 20  # of input in one micro-batch
LOG = "h1 bigint, h2 bigint, t bigint, id bigint, kind string"


class Gone:
    """The identifiers that left a bucket's state: Bloom filters, each of twice the size of the one before.

    At 16 bits and 6 places an identifier, about one in a thousand others is
    taken for one of them, which costs a lookup and changes nothing.
    """

    FIRST, BITS, PLACES = 1 << 10, 16, 6  # identifiers in the first filter, bits for each

    def __init__(self, data: bytes = b""):
        self.counts: list[int] = []
        self.filters: list[np.ndarray] = []
        at = 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "big")
            size = (self.FIRST << len(self.filters)) * self.BITS // 8
            self.counts.append(n)
            self.filters.append(np.frombuffer(data[at + 8 : at + 8 + size], np.uint8).copy())
            at += 8 + size

    def places(self, h1: np.ndarray, h2: np.ndarray, k: int) -> np.ndarray:
        bits = np.uint64((self.FIRST << k) * self.BITS)
        a, b = h2.astype(np.uint64), (h1.astype(np.uint64) >> np.uint64(20)) | np.uint64(1)  # h1's lowest bits are those of the bucket
        return np.stack([(a + np.uint64(i) * b) % bits for i in range(self.PLACES)])

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = 0
        while at < len(h1):
            if not self.filters or self.counts[-1] >= self.FIRST << (len(self.filters) - 1):
                self.filters.append(np.zeros((self.FIRST << len(self.filters)) * self.BITS // 8, np.uint8))
                self.counts.append(0)
            k = len(self.filters) - 1
            n = min(len(h1) - at, (self.FIRST << k) - self.counts[k])
            p = self.places(h1[at : at + n], h2[at : at + n], k).ravel()
            np.bitwise_or.at(self.filters[k], (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.int64)).astype(np.uint8))
            self.counts[k] += n
            at += n

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for k, f in enumerate(self.filters):
            p = self.places(h1, h2, k)
            found |= ((f[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
        return found

    def data(self) -> bytes:
        return b"".join(n.to_bytes(8, "big") + f.tobytes() for n, f in zip(self.counts, self.filters))


def best_first(h1, h2, t, i, source) -> tuple[np.ndarray, np.ndarray]:
    """The order by key, time, id and source, and in it a flag at the first of each key."""
    by = np.lexsort((source, i, t, h2, h1))
    a, b = h1[by], h2[by]
    first = np.ones(len(by), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return by, first


def combiner(buckets: int):
    """Within a task: one candidate per key goes to the key's bucket, the other copies to the bucket of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            h1, h2, t, i = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(4))
            by, first = best_first(h1, h2, t, i, np.zeros(len(h1), np.int8))
            h1, h2, t, i = h1[by], h2[by], t[by], i[by]
            bucket = np.where(first, h1, i ^ t) % buckets
            return pa.record_batch([pa.array(x) for x in (bucket.astype(np.int32), ~first, h1, h2, t, i)], names=["bucket", "spare", *FIELDS])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= COMBINE_ROWS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def merge(state: np.ndarray, new: np.ndarray, watermark: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Columns h1, h2, t, id, last seen of the state and of new rows; gives the new state, what leaves it, and rows by kind.

    ``fresh`` rows are kept of identifiers that the state did not hold, ``better``
    ones replace a row of the state, which is ``replaced``; all others are ``dropped``.
    """
    every = np.concatenate([state, new], axis=1)
    source = np.r_[np.zeros(state.shape[1], np.int8), np.ones(new.shape[1], np.int8)]
    by, first = best_first(*every[:4], source)
    every, source = every[:, by], source[by]
    starts = np.flatnonzero(first)
    best = every[:, starts].copy()
    held = np.zeros(len(starts), bool)
    if len(starts):
        best[4] = np.maximum.reduceat(every[4], starts)
        held = np.minimum.reduceat(source, starts) == 0
    is_new = source == 1
    rows = every[:4]
    of_held = np.repeat(held, np.diff([*starts, every.shape[1]])) if len(starts) else np.zeros(0, bool)
    kinds = {"fresh": rows[:, first & is_new & ~of_held], "better": rows[:, first & is_new & of_held], "replaced": rows[:, ~first & ~is_new], "dropped": rows[:, ~first & is_new]}
    stays = best[4] >= watermark
    return best[:, stays], best[:2, ~stays], kinds


def keeper(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    old, gone = state.get if state.exists else (b"", b"")
    old, gone = np.frombuffer(old, np.int64).reshape(5, -1) if old else np.empty((5, 0), np.int64), Gone(gone)
    watermark = state.getCurrentWatermarkMs() * 1000
    new = []
    for f in frames:
        spare = f["spare"].to_numpy(bool)
        rows = f[list(FIELDS)].to_numpy(np.int64).T
        if spare.any():
            yield pd.DataFrame(dict(zip(FIELDS, rows[:, spare])) | {"kind": "dropped"})
        new.append(rows[:, ~spare])
    rows = np.concatenate(new, axis=1) if new else np.empty((4, 0), np.int64)
    seen = np.where(rows[2] == LAST, 0, rows[2])[None]
    live, left, kinds = merge(old, np.concatenate([rows, seen]), watermark)
    back = gone.has(*kinds["fresh"][:2])
    gone.add(*left)
    state.update((np.ascontiguousarray(live).tobytes(), gone.data()))
    kinds["back"], kinds["fresh"] = kinds["fresh"][:, back], kinds["fresh"][:, ~back]
    for kind, x in kinds.items():
        if x.shape[1]:
            yield pd.DataFrame(dict(zip(FIELDS, x)) | {"kind": kind})


@dataclass
class Deduplicated:
    """``kept`` and ``dropped``: the ids (``row_id``) of each, together all rows."""

    kept: DataFrame
    dropped: DataFrame


def settle(log: DataFrame, id_col: str, folder: RunFolder | None = None) -> Deduplicated:
    """The late-arrival lookup: which entries of identifiers that came back lose against those before or after them.

    The identifiers that came back select their entries of the log, and of each
    of them the first stays; rows that are equal in all count as often as they
    are. All other entries are settled as they stand.
    """
    ident = F.when(F.col("id") == int(LAST), None).otherwise(F.col("id")).alias(id_col)
    back = log.filter("kind = 'back'").select("h1", "h2").distinct()
    entries, replaced = log.filter("kind in ('fresh', 'better', 'back')").select(*FIELDS), log.filter("kind = 'replaced'").select(*FIELDS)
    counted = lambda df, n: df.join(back, ["h1", "h2"], "left_semi").withColumn("n", F.lit(n))
    again = counted(entries, 1).unionAll(counted(replaced, -1)).groupBy(*FIELDS).agg(F.sum("n").alias("n")).filter("n > 0")
    again = again.withColumn("first", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("t", "id")) == 1)
    again = folder.write(again, "again") if folder else again
    late = again.withColumn("more", F.explode(F.expr("sequence(1, cast(n as int) + 1)"))).filter(F.col("more") <= F.col("n") - F.col("first").cast("int"))
    lost = log.filter("kind in ('dropped', 'replaced')").select(ident).unionAll(late.select(ident))
    kept = entries.join(back, ["h1", "h2"], "left_anti").join(replaced, list(FIELDS), "left_anti").unionAll(again.filter("first").select(*FIELDS))
    return Deduplicated(kept.select(ident), lost)


def deduplicate_stream(
    stream: DataFrame,
    keys: list[Column],
    time_col: str,
    id_col: str,
    folder: RunFolder,
    delay: str = "1 day",
    buckets: int | None = None,
) -> DataFrame:
    """Run what is available of ``stream`` through the state store; gives the log of kept and dropped rows.

    Of rows with equal ``keys`` (null equals null) the one with the earliest
    ``time_col``, then the smallest ``id_col`` (BIGINT), is kept; null times and
    ids come last. Run again over the same folder, it goes on where it stopped,
    also after a failure. The number of ``buckets``, by default BUCKETS_A_CORE
    for each core of the cluster, and of state partitions is fixed by the first
    run. A bucket is rewritten by each micro-batch, so there should be enough for
    the identifiers alive within ``delay``. An empty stream gives an empty log.
    """
    spark = stream.sparkSession
    if folder.exists("buckets"):
        buckets = spark.read.schema("n int").parquet(f"{folder.path}/buckets").first()[0]
    else:
        buckets = buckets or max(LEAST_BUCKETS, BUCKETS_A_CORE * spark.sparkContext.defaultParallelism)
        folder.write(spark.range(1).select(F.lit(buckets).cast("int").alias("n")), "buckets")
    h1, h2 = key_hashes(F.col("key"))
    rows = stream.select(
        key_text(keys).alias("key"),
        F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(int(LAST))).alias("t"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(LAST))).alias("id"),
    ).select(h1.alias("h1"), h2.alias("h2"), "t", "id")
    out = (
        rows.mapInArrow(combiner(buckets), "bucket int, spare boolean, h1 bigint, h2 bigint, t bigint, id bigint")
        .withColumn("event_time", F.timestamp_micros(F.when(F.col("t") == int(LAST), 0).otherwise(F.col("t"))))
        .withWatermark("event_time", delay)
        .groupBy("bucket")
        .applyInPandasWithState(keeper, LOG, "seen binary, gone binary", "append", "NoTimeout")
    )
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = out.writeStream.format("parquet").option("path", f"{folder.path}/log").option("checkpointLocation", f"{folder.path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(LOG).parquet(f"{folder.path}/log")


def file_stream(spark: SparkSession, path: str, batch_bytes: int | None = None) -> DataFrame:
    """A stream of a parquet folder or file in micro-batches of ``batch_bytes``, by default BATCH_BYTES_A_CORE for each core.

    The batch grows with the cluster and not with the input, whose size gives
    the number of batches.
    """
    least = batch_bytes or BATCH_BYTES_A_CORE * max(spark.sparkContext.defaultParallelism, 8)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(least))
    return reader.parquet(path + "{}")  # the streaming source takes a single file only as a pattern


def deduplicate_files(spark: SparkSession, path: str, keys: list[Column], time_col: str, id_col: str, folder: RunFolder | None = None, batch_bytes: int | None = None, **options) -> Deduplicated:
    """``deduplicate_stream`` over the files of a parquet table, then the late-arrival lookup.

    With the ``folder`` of an earlier run over the same ``path`` only new files
    are read, and the result is that of all.
    """
    folder = folder or RunFolder(spark, "dedup")
    log = deduplicate_stream(file_stream(spark, path, batch_bytes), keys, time_col, id_col, folder, **options)
    return settle(log, id_col, folder)
