"""Deeply nested records as flat tables, linked by interval labels."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.functions.trees import OBJECT, SCALAR, Number, label, parents, root_of
from sigtrace.operators.joins import in_interval

NODE_FIELDS = {
    "field_name": T.StringType(),
    "kind": T.StringType(),
    "pre": T.LongType(),
    "post": T.LongType(),
    "level": T.IntegerType(),
    "object_path": T.StringType(),
    "parent_pre": T.LongType(),
    "parent_path": T.StringType(),
    "value": T.StringType(),
    "members": T.MapType(T.StringType(), T.StringType()),
}
_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), NODE_FIELDS["members"]: pa.map_(pa.string(), pa.string())}
PLACES = {"kind": 0, "pre": 1, "post": 2, "level": 3, "object_path": 4}  # in what label gives
FLUSH_NODES = 1 << 17


def _scalar_text(v) -> str | None:
    if v is None or isinstance(v, (str, Number)):
        return v
    return "true" if v else "false"


def _utf8(s: str | None) -> str | None:
    return s if s is None else s.encode("utf-8", "replace").decode()


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_string(kind):
        return _strings(values)
    if not pa.types.is_map(kind):
        return pa.array(values, kind)
    flat = [m for m in values if m is not None]
    ends = accumulate(0 if m is None else len(m) for m in values)
    starts = [None if m is None else at for m, at in zip(values, chain((0,), ends))]
    try:
        keys = pa.array([k for m in flat for k in m], pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):
        return pa.array([m if m is None else list({_utf8(k): _utf8(_scalar_text(v)) for k, v in m.items()}.items()) for m in values], kind)
    return pa.MapArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), keys, _strings([_scalar_text(v) for m in flat for v in m.values()]))


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):  # half of a surrogate pair in a key or value
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def nodes(
    df: DataFrame,
    ids: list[str],
    trees: dict[str, Column],
    kinds: tuple[str, ...] = (OBJECT,),
    columns: tuple[str, ...] = tuple(NODE_FIELDS),
    root: bool = True,
) -> DataFrame:
    """One row per node of the JSON trees of each row: ``ids`` and the ``columns`` of NODE_FIELDS.

    Every node gets interval labels by depth-first traversal, and its parent is
    the nearest object whose interval contains it (``parent_path`` is empty for
    the root, also if that is an array, and null for the root itself). A string
    that is the text of an object or array counts as that. Null, empty and
    invalid trees give no rows, nor does a tree that is a single scalar; of
    repeated keys the last counts; repeated rows count each; trees may be nested
    at any depth. ``members`` are an object's scalar members as a map of texts, ``value`` is a
    scalar's text; both are null for a JSON null.
    Id columns may have any name but those of NODE_FIELDS.
    """
    clash = sorted(set(ids) & set(columns))
    if clash:
        raise ValueError(f"id columns named like node columns: {clash}")
    source = df.select(*[F.col(c) for c in ids], *[t.cast("string").alias(f"_tree{i}") for i, t in enumerate(trees.values())])
    schema = T.StructType([*[source.schema[c] for c in ids], *[T.StructField(c, NODE_FIELDS[c]) for c in columns]])
    names, n_ids, wanted = list(trees), len(ids), frozenset((*kinds, OBJECT))
    arrow = [_ARROW[NODE_FIELDS[c]] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in columns]
            rows: list[int] = []

            def flush() -> pa.RecordBatch:
                take = pa.array(rows, pa.int64())
                done = [_column(v, t) for v, t in zip(cols, arrow)]
                return pa.record_batch([*[batch.column(i).take(take) for i in range(n_ids)], *done], names=[*batch.schema.names[:n_ids], *columns])

            for j, name in enumerate(names):
                for row, text in enumerate(batch.column(n_ids + j).to_pylist()):
                    tree = root_of(text)
                    if tree is None:
                        continue
                    found = label(tree, wanted, "members" in columns)
                    kept = [(n, found[up] if up >= 0 else None) for n, up in zip(found, parents(found)) if n[0] in kinds and (root or n[3])]
                    rows.extend(repeat(row, len(kept)))
                    for c, to in zip(columns, cols):
                        if c == "field_name":
                            to.extend(repeat(name, len(kept)))
                        elif c in PLACES:
                            k = PLACES[c]
                            to.extend([n[k] for n, _ in kept])
                        elif c == "parent_path":
                            to.extend([at[4] if at else "" if n[3] else None for n, at in kept])
                        elif c == "parent_pre":
                            to.extend([at[1] if at else 0 if n[3] else None for n, at in kept])
                        elif c == "members":
                            to.extend([n[5] if n[0] == OBJECT else None for n, _ in kept])
                        else:
                            to.extend([_scalar_text(n[5]) if n[0] == SCALAR else None for n, _ in kept])
                    if len(rows) >= FLUSH_NODES:
                        yield flush()
                        rows, cols = [], [[] for _ in columns]
            if rows:
                yield flush()

    return source.mapInArrow(run, schema)


def type_path(path: Column) -> Column:
    """A node's type: its pointer with array positions written as ``*``."""
    return F.regexp_replace(path, r"/[0-9]+(?=/|$)", "/*")


def within(inner: DataFrame, outer: DataFrame, ids: list[str], width: int = 64) -> DataFrame:
    """Pairs of nodes of one record and tree with the outer around the inner one, by interval containment.

    The nodes inside a node follow it in pre-order, as many as ``post - pre +
    level``, so containment is a point in a span and an equi-join on record and
    block; no pairs of a record's nodes are tried that lie far from each other.
    The outer node's columns come as ``outer_...``; it needs ``pre``, ``post``
    and ``level``. Null ids equal each other.
    """
    keys = [*ids, "field_name"]
    record = F.to_json(F.struct(*[F.col(c) for c in keys]), {"ignoreNullFields": "false"}).alias("_record")
    o = outer.select(record, *[F.col(c).alias(f"outer_{c}") for c in outer.columns if c not in keys])
    o = o.withColumn("_from", F.col("outer_pre") + 1).withColumn("_to", F.col("outer_post") + F.col("outer_level"))
    return in_interval(inner.select("*", record), o.filter("_to >= _from"), ["_record"], "pre", "_from", "_to", width).drop("_record", "_from", "_to")


ROOT = "(root)"  # the node type of roots, whose pointer is empty
TABLE = ("field_name", "kind", "node_type")
NODE_COLUMNS = ("pre", "post", "level", "parent_pre", "object_path", "value", "members")


class NodeTables:
    """One table per kind and node type, linked by their labels: ``ids, pre, post, level, parent_pre, object_path, value, members``.

    Written once below ``path``, a folder per field, kind and type, named by their
    hash, as a pointer may be longer than a file name. ``found`` without ``kind``
    holds objects, and without ``value`` that column is null. Types are spread
    over ``ranges`` tasks: small ones go together, one with most nodes is cut into
    several.
    """

    def __init__(self, found: DataFrame, path: str, ids: list[str], ranges: int = 1024):
        self.spark, self.path, self.ids = found.sparkSession, path, ids
        for c, v in {"kind": F.lit(OBJECT), "value": F.lit(None).cast("string")}.items():
            found = found if c in found.columns else found.withColumn(c, v)
        pointer = F.col("object_path")
        rows = found.withColumn("node_type", F.when(pointer == "", ROOT).otherwise(type_path(pointer)))
        rows = rows.select(F.xxhash64(*TABLE).alias("_table"), *TABLE, *ids, *NODE_COLUMNS)
        rows.hint("rebalance", ranges, "_table").sortWithinPartitions("_table").write.mode("overwrite").partitionBy("_table").parquet(path)
        self.schema = rows.schema

    @property
    def _files(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @property
    def all(self) -> DataFrame:
        return self._files.select(*self.ids, *NODE_COLUMNS, *TABLE)

    def types(self) -> DataFrame:
        """``field_name, kind, node_type, n_nodes`` of the tables there are."""
        return self._files.groupBy(*TABLE).agg(F.count("*").alias("n_nodes"))

    def table(self, field_name: str, node_type: str, columns: dict[str, str], kind: str = OBJECT) -> DataFrame:
        """The nodes of one type with members as typed columns: name to type; null where one is absent or does not fit.

        A scalar's value stands under each name. Only this type's files are read.
        """
        its = [F.lit(field_name), F.lit(kind), F.lit(node_type)]
        rows = self._files.filter(F.col("_table") == F.xxhash64(*its))
        for c, v in zip(TABLE, its):
            rows = rows.filter(F.col(c) == v)
        cell = (lambda c: F.col("value")) if kind == SCALAR else (lambda c: F.try_element_at("members", F.lit(c)))
        return rows.select(*self.ids, "pre", "post", "level", "parent_pre", *[cell(c).try_cast(t).alias(c) for c, t in columns.items()])
