"""Writing tables with a manifest that appears last."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _row_sums(df: DataFrame) -> list[Column]:
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n"), total(F.xxhash64(row)).alias("a"), total(F.xxhash64(F.lit(7), row)).alias("b")]


def _digest(n, a, b) -> str:
    return hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()


def digest_of(df: DataFrame, order: list[str] | None = None) -> str:
    """A digest of a table's rows, independent of their order: the sums of the rows' 128-bit hashes and their number."""
    return _digest(*df.select("*").agg(*_row_sums(df)).first())


def canonical_line(df: DataFrame) -> Column:
    """``line``: a row as compact JSON with its columns in the order of their names, nulls written."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("line")


def write_lines(df: DataFrame, path: str, order: list[str]) -> dict:
    """Canonical JSON lines in ``order`` over the files of a folder; gives the number of lines and a digest of each file and of all.

    Files are ranges of the order, so their digests in the order of their names,
    one a line, give the digest of the whole; it depends on how many there are.
    """
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(*[F.col(c).alias(n) for c, n in zip(order, names)], canonical_line(df))
    count = Observation()  # behind the ranges, whose bounds take a pass of their own
    ranged = keyed.repartitionByRange(*names, "line").sortWithinPartitions(*names, "line").select("line")
    ranged.observe(count, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    files = [(r.name, r.sha256) for r in parts.orderBy("name").collect()]  # as many as there were tasks
    return {"lines": count.get["n"], "files": dict(files), "digest": hashlib.sha256("\n".join(h for _, h in files).encode()).hexdigest()}


def write_document(spark: SparkSession, path: str, document) -> str:
    """One small answer as an indented JSON file with sorted keys, put in place whole; gives its SHA-256."""
    body = json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False, default=str).encode()
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = to.suffix(".part")
    out = fs.create(part, True)
    out.write(bytearray(body))
    out.close()
    fs.delete(to, False)
    fs.rename(part, to)
    return hashlib.sha256(body).hexdigest()


def write_documents(df: DataFrame, path: str, ident: str, document: str, buckets: int = 64) -> DataFrame:
    """JSON documents of many records as lines below ``path/documents``, by hash bucket of their id, and an index of them:
    ``ident, bucket, sha256, n_bytes``. One pass over the records for each of the two."""
    d = df.select(F.col(ident).alias(ident), F.col(document).cast("string").alias("document")).withColumn("bucket", F.pmod(F.xxhash64(F.col(ident).cast("string")), F.lit(buckets)).cast("int"))
    d.repartitionByRange("bucket", ident).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/documents")
    index = d.select(ident, "bucket", F.sha2("document", 256).alias("sha256"), F.octet_length("document").alias("n_bytes"))
    index.write.mode("overwrite").parquet(f"{path}/index")
    return df.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def publish(tables: dict[str, DataFrame], path: str, form: str = "parquet", by: dict[str, list[str]] | None = None) -> dict:
    """Write the tables below ``path``, then ``manifest.json`` with counts and digests, which are taken while writing.

    Readers that wait for the manifest never see half a result. Names must be
    plain, and a folder that has a manifest is not written again.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = jvm.org.apache.hadoop.fs.Path(root, "manifest.json")
    if fs.exists(last):
        raise ValueError(f"{path} has been published")
    entries = {}
    for name, df in tables.items():
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise ValueError(f"no plain name: {name}")
        sums = Observation()
        writer = df.observe(sums, *_row_sums(df)).write.mode("overwrite").format(form)
        (writer.partitionBy(*by[name]) if by and name in by else writer).save(f"{path}/{name}")
        got = sums.get
        entries[name] = {"rows": got["n"], "digest": _digest(got["n"], got["a"], got["b"]), "format": form, "schema": df.schema.json()}
    manifest = {"tables": entries}
    out = fs.create(jvm.org.apache.hadoop.fs.Path(root, "manifest.tmp"), True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()))
    out.close()
    fs.rename(jvm.org.apache.hadoop.fs.Path(root, "manifest.tmp"), last)
    return manifest


def verify(spark: SparkSession, path: str) -> dict[str, bool]:
    """Whether each table of a manifest still has its rows and digest."""
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))
    out = {}
    for name, e in manifest["tables"].items():
        df = spark.read.format(e["format"]).schema(T.StructType.fromJson(json.loads(e["schema"]))).load(f"{path}/{name}")
        out[name] = digest_of(df) == e["digest"]
    return out
