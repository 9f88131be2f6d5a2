"""Reading decoded records: JSON lines with the broken ones set apart, whole documents, and tables by range."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.functions.trees import parse


def json_kind(c: Column) -> Column:
    """object, array or scalar of strict JSON text, null for anything else.

    An Arrow UDF: the built-in parsers take text with more behind the value.
    """

    @F.pandas_udf(T.StringType())
    def kind(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                v = parse(t)
            except ValueError:
                return None
            return "object" if type(v) is dict else "array" if type(v) is list else "scalar"

        return pd.Series([one(t) for t in texts], dtype=object)

    return kind(c.cast("string"))


def split_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``state`` of each line: ok (a JSON object), blank, not_json or not_object. Nothing is dropped."""
    kinds = lines.withColumn("_kind", json_kind(F.col(line)))
    blank = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\s+", "") == ""
    state = F.when(blank, "blank").when(F.col("_kind").isNull(), "not_json").when(F.col("_kind") == "object", "ok").otherwise("not_object")
    return kinds.withColumn("state", state).drop("_kind")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file; ``split_lines`` sorts them."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"))


def read_records(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Typed records of JSON lines. Broken lines stand in ``_corrupt_record``, or raise if ``strict``."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    full = schema if strict else T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(full).option("mode", mode)
    return (reader if strict else reader.option("columnNameOfCorruptRecord", "_corrupt_record")).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file: its text, its file and whether it is JSON."""
    d = spark.read.text(path, wholetext=True).select(F.col("value").alias("document"), F.col("_metadata.file_path").alias("file_path"))
    return d.withColumn("valid", json_kind(F.col("document")).isNotNull())


def select_events(events: DataFrame, frames: tuple[int, int] | None = None, protocols: list[str] | None = None, ids: dict[str, str] | None = None) -> DataFrame:
    """Events by range of frames (inclusive), protocol and identifier; all tests reach the scan."""
    tests: list[Column] = []
    if frames:
        tests.append(F.col("frame").between(*frames))
    if protocols is not None:
        tests.append(F.col("protocol").isin(protocols))
    tests += [F.col(k) == v for k, v in (ids or {}).items()]
    for t in tests:
        events = events.filter(t)
    return events


def authorised(rows: DataFrame, allowed: Column) -> DataFrame:
    """The rows, or an error as soon as one is outside of what is allowed."""
    return rows.filter(F.when(F.coalesce(allowed, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("outside of the capability")).cast("boolean")))
