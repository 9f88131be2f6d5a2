"""Tables written to the folder all executors share, to cut lineage durably."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode.

    A machine-local folder would not be seen by other executors, so on a cluster
    without the setting this raises.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sigtrace-')}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _sweep(path: str) -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:
        pass


class RunFolder:
    """A folder of one run's tables below ``shared_dir``, removed by ``close``, at the end of ``with``, or as Python ends.

    With ``path`` it is that folder, which stays, so that a later run can go on from it.
    """

    def __init__(self, spark: SparkSession, what: str, path: str | None = None):
        self.spark = spark
        self.stays = path is not None
        self.path = path.rstrip("/") if path else f"{shared_dir(spark)}/sigtrace/{what}-{uuid.uuid4().hex}"
        self._at_exit = None if self.stays else partial(_sweep, self.path)
        if self._at_exit:
            atexit.register(self._at_exit)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table and read it back: later steps start from files, not from lineage."""
        to = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def size(self, name: str) -> int:
        """Bytes of a table written here; 0 if there is none."""
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def exists(self, name: str) -> bool:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        return fs.exists(p)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Remove the folder, once nothing reads its tables any more; a folder that stays is left as it is."""
        if self._at_exit:
            delete(self.spark, self.path)
            atexit.unregister(self._at_exit)
            self._at_exit = None

    def __enter__(self) -> RunFolder:
        return self

    def __exit__(self, *_) -> None:
        self.close()
