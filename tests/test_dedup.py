import datetime as dt
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtrace.operators.dedup import first_copies
from sigtrace.sources.shared import RunFolder
from sigtrace.streaming.dedup import Gone, deduplicate_files, deduplicate_stream, settle

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2026, 1, 1)
SCHEMA = "row_id long, k string, n int, received_at timestamp, h1 string"


def brute(rows):
    best, lost = {}, []
    far = dt.datetime(9999, 1, 1)
    for r in sorted(rows, key=lambda r: (r[3] or far, r[0])):
        (lost.append(r[0]) if (r[1], r[2]) in best else best.setdefault((r[1], r[2]), r[0]))
    return sorted(best.values()), sorted(lost)


def write(spark, rows, path, parts=1):
    step = max(1, -(-len(rows) // parts))
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def found(result):
    return sorted(r[0] for r in result.kept.collect()), sorted(r[0] for r in result.dropped.collect())


ROWS = [
    (1, "a", 1, T0 + DAY, "x"), (2, "a", 1, T0, "x"), (3, "a", 1, T0, "y"), (4, None, 1, T0, None), (5, None, 1, None, None), (6, "a", None, T0, None),
    (7, "a", None, T0 + 9 * DAY, None), (8, "", 1, T0, ""), (9, "b", 2, None, ""), (10, "b", 2, None, ""), (11, "a", 1, T0 + 30 * DAY, None), (12, "c", 3, T0 + 30 * DAY, None),
    (13, "c", 3, T0 - 5 * DAY, None), (14, "a", 1, T0 - 9 * DAY, None), (15, "c", 3, T0 + 2 * DAY, None),
]


@pytest.mark.parametrize("parts", [1, 4])
def test_keeps_the_first_copy_however_late(spark, tmp_path, parts):
    """With several micro-batches most copies come after their identifier has left the state."""
    path = str(tmp_path / "t")
    write(spark, ROWS, path, parts)
    for i, f in enumerate(sorted(glob.glob(f"{path}/*.parquet"), key=os.path.getmtime)):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    keys = [F.col("k"), F.col("n")]
    log = deduplicate_stream(stream, keys, "received_at", "row_id", RunFolder(spark, "t"), delay="1 hour", buckets=3)
    assert found(settle(log, "row_id")) == brute(ROWS)


def test_goes_on_where_it_stopped(spark, tmp_path):
    path, folder = str(tmp_path / "t"), RunFolder(spark, "t")
    keys = [F.col("k"), F.col("n")]
    for part in (ROWS[:6], ROWS[6:]):
        write(spark, part, path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        log = deduplicate_stream(stream, keys, "received_at", "row_id", folder, delay="2 days", buckets=2)
    assert found(settle(log, "row_id")) == brute(ROWS)


def test_runs_over_new_files_look_up_returning_keys_only(spark, tmp_path):
    """A second run reads new files alone; identifiers that never came back are not looked up, whatever came before."""
    path, keys = str(tmp_path / "t"), [F.col("k"), F.col("n")]
    folder = RunFolder(spark, "t", str(tmp_path / "state"))
    first = [(i, f"k{i}", 1, T0 + dt.timedelta(minutes=i), None) for i in range(3000)]
    second = [(5000 + i, f"k{i * 40}", 1, T0 + 9 * DAY + dt.timedelta(minutes=i), None) for i in range(50)] + [(9000 + i, f"new{i}", 1, T0 + 9 * DAY, None) for i in range(500)]
    third = [(7, "k7", 1, T0 + dt.timedelta(minutes=7), None)] * 2 + [(9900, "k8", 1, T0 - DAY, None)]
    for part in (first, second, third):
        write(spark, part, path)
        result = deduplicate_files(spark, path, keys, "received_at", "row_id", folder=RunFolder(spark, "t", folder.path), delay="1 hour", buckets=4)
    assert found(result) == brute(first + second + third)
    log = spark.read.parquet(f"{folder.path}/log")
    # The watermark of a batch is that of those before it: in the third run k7 and k8 have left the state, in the second none has.
    assert 2 <= log.filter("kind = 'back'").count() < 10 and log.filter("kind = 'fresh'").count() >= 3490
    folder.close()
    assert folder.exists("log")


def test_filters_of_identifiers_that_left():
    rnd = np.random.default_rng(3)
    h = rnd.integers(-(2**63), 2**63 - 1, (2, 40_000))
    gone = Gone()
    for part in np.array_split(h[:, :20_000], 7, axis=1):
        gone = Gone(gone.data())
        gone.add(*part)
    gone = Gone(gone.data())
    assert gone.has(*h[:, :20_000]).all() and gone.has(*h[:, 20_000:]).mean() < 0.005 and sum(gone.counts) == 20_000
    assert not Gone().has(*h).any()


def test_hot_key_and_empty_table(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}", 1, T0 + dt.timedelta(seconds=i * 7919 % 5000), None) for i in range(3000)]
    path = str(tmp_path / "t")
    write(spark, rows, path, 2)
    assert found(deduplicate_files(spark, path, [F.col("k"), F.col("n")], "received_at", "row_id")) == brute(rows)
    empty = str(tmp_path / "e")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    assert found(deduplicate_files(spark, empty, [F.col("k")], "received_at", "row_id")) == ([], [])


def test_first_copies(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = first_copies(df, {"k": F.col("k"), "n": F.col("n")}, ["received_at", "row_id"], {"row_id": F.col("row_id")})
    assert sorted(r.row_id for r in got.collect()) == brute(ROWS)[0]
    assert first_copies(df.limit(0), {"k": F.col("k")}, ["row_id"], {"n": F.col("n")}).count() == 0
