"""Schemas that drift between files: a catalogue of field lifespans, its changes, and one consistent table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.functions.trees import Number, parse
from sigtrace.operators.components import smallest_labels
from sigtrace.operators.ordered import with_neighbours, with_position
from sigtrace.sources.shared import RunFolder

OPENED = ("transport",)  # objects whose members are fields of their own, by their path
BLOCK = 4096
FLAGS = ("all_integers", "longs", "doubles")  # of a field's values, see catalogue


def fields_of(line: str | None, opened: tuple[str, ...] = OPENED) -> dict | None:
    """The fields of a line's record, None if the line is not a JSON object; members of objects in ``opened`` as ``path.x``."""
    if line is None:
        return None
    try:
        record = parse(line)
    except ValueError:
        return None
    if type(record) is not dict:
        return None
    todo = [p for p in sorted(opened, key=lambda p: p.count(".")) if type(record.get(p)) is dict or "." in p]
    for path in todo:
        inner = record.get(path)
        if type(inner) is dict:
            record = {k: v for k, v in record.items() if k != path} | {f"{path}.{k}": v for k, v in inner.items()}
    return record


def kind_of(v) -> str:
    """The JSON kind of a value that is not null."""
    t = type(v)
    if t is Number:
        return v.kind
    return {str: "string", bool: "boolean", list: "array", dict: "object"}[t]


def text_of(v) -> str:
    """A value as text: strings and numbers as they stand, trees without blanks."""
    if isinstance(v, str):
        return v
    if type(v) is bool:
        return "true" if v else "false"
    return _json(v)


def _json(v) -> str:
    if type(v) is Number:
        return str(v)
    if type(v) is dict:
        return "{" + ",".join(f"{json.dumps(k)}:{_json(x)}" for k, x in v.items()) + "}"
    if type(v) is list:
        return "[" + ",".join(map(_json, v)) + "]"
    return json.dumps(v)


def _utf8(s: str) -> str:
    return s.encode("utf-8", "replace").decode()


def _is_integer(s: str) -> bool:
    return len(s) <= 18 and s.isascii() and (s[1:] if s[:1] == "-" else s).isdigit()


def _is_long(s: str) -> bool:
    """Whether BIGINT holds a JSON integer."""
    return len(s) <= 18 or len(s) <= 20 and -(1 << 63) <= int(s) < 1 << 63


def _is_double(s: str) -> bool:
    """Whether a JSON number comes back from DOUBLE with the same value, written with up to 17 digits."""
    if len(s) <= 15 and "e" not in s and "E" not in s:
        return True
    f = float(s)
    return f - f == 0 and Decimal(repr(f)) == Decimal(s)


def catalogue(lines: DataFrame, opened: tuple[str, ...] = OPENED) -> DataFrame:
    """``file_id, field, kind, n_values, all_integers, longs, doubles`` of each file's fields with a value other than null.

    ``all_integers`` says that every value's text is an integer of up to 18
    digits, ``longs`` and ``doubles`` that every number is one that BIGINT and
    DOUBLE hold. Counts are made up within each task first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, list] = {}
            for fid, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, v in (fields_of(line, opened) or {}).items():
                    if v is None:
                        continue
                    at = counts.setdefault((fid, _utf8(name), kind_of(v)), [0, True, True, True])
                    at[0] += 1
                    at[1] = at[1] and isinstance(v, str) and _is_integer(v)
                    if type(v) is Number:
                        at[2] = at[2] and v.kind == "integer" and _is_long(v)
                        at[3] = at[3] and _is_double(v)
            if counts:
                fid, name, kind = zip(*counts)
                n, *flags = zip(*counts.values())
                yield pa.record_batch([pa.array(fid, pa.int64()), pa.array(name), pa.array(kind), pa.array(n, pa.int64()), *map(pa.array, flags)], names=["file_id", "field", "kind", "n_values", *FLAGS])

    found = lines.select(F.col("file_id").cast("bigint"), F.col("line").cast("string")).mapInArrow(run, "file_id bigint, field string, kind string, n_values bigint, " + ", ".join(f"{f} boolean" for f in FLAGS))
    return found.groupBy("file_id", "field", "kind").agg(F.sum("n_values").alias("n_values"), *[F.bool_and(f).alias(f) for f in FLAGS])


def positions(files: DataFrame) -> DataFrame:
    """``stream_id, pos, file_id``: the files of each stream numbered by ``file_seq``, then ``file_id``."""
    f = files.select("stream_id", "file_seq", F.col("file_id").cast("bigint").alias("file_id"))
    return with_position(f, ["stream_id"], F.floor(F.col("file_seq") / BLOCK), ["file_seq", "file_id"], "pos").select("stream_id", "pos", "file_id")


def lifespans(presence: DataFrame, by: list[str]) -> DataFrame:
    """Islands of consecutive files: rows of ``presence`` (distinct ``by`` and ``pos``) with flags ``starts`` and ``ends``."""
    n = with_neighbours(presence, by, "pos", BLOCK)
    return n.withColumn("starts", ~F.col("pos_before").eqNullSafe(F.col("pos") - 1)).withColumn("ends", ~F.col("pos_after").eqNullSafe(F.col("pos") + 1)).drop("pos_before", "pos_after")


def _values(lines: DataFrame, roles: DataFrame, opened: tuple[str, ...]) -> DataFrame:
    """``stream_id, pos, side, record_id, field, h1, h2`` of the records of files with a role; a row with null field per record."""
    schema = "stream_id bigint, pos bigint, side int, record_id string, field string, h1 bigint, h2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for line, roles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = fields_of(line, opened)
                rid = record and record.get("record_id")
                if rid is None:
                    continue
                rid = _utf8(text_of(rid))
                named = {_utf8(k): v for k, v in record.items()}
                for role in roles:
                    at = (role["stream_id"], role["pos"], role["side"], rid)
                    out.append((*at, None, 0, 0))
                    for name in role["fields"]:
                        v = named.get(name)
                        if v is not None:
                            h = hashlib.blake2b(f"{rid}\0{text_of(v)}".encode("utf-8", "replace"), digest_size=16).digest()
                            out.append((*at, name, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["stream_id", "pos", "side", "record_id", "field", "h1", "h2"])

    per_file = roles.groupBy("file_id").agg(F.collect_list(F.struct("stream_id", "pos", "side", "fields")).alias("roles"))  # at most two
    source = lines.select(F.col("file_id").cast("bigint"), F.col("line").cast("string").alias("line")).join(per_file, "file_id").select("line", "roles")
    return source.mapInArrow(run, schema)


def renames(lines: DataFrame, where: DataFrame, went: DataFrame, came: DataFrame, opened: tuple[str, ...] = OPENED) -> DataFrame:
    """``stream_id, pos, old_name, new_name`` of fields with the same values in all records that both files hold.

    A field's values over the shared records are one 128-bit fingerprint (the
    sum of the records' hashes), so old and new names meet in an equi-join and
    not as pairs. At least one shared record must hold a value. Of several
    fields with the same values those at the same place in name order belong
    together.
    """
    both = went.select("stream_id", "pos").distinct().join(came.select("stream_id", "pos").distinct(), ["stream_id", "pos"])
    sides = []
    for side, fields, back in ((0, went, 1), (1, came, 0)):
        named = fields.join(both, ["stream_id", "pos"], "left_semi").groupBy("stream_id", "pos").agg(F.collect_set("field").alias("fields"))
        sides.append(named.withColumn("at", F.col("pos") - back).join(where.select(F.col("stream_id"), F.col("pos").alias("at"), "file_id"), ["stream_id", "at"]).select("file_id", "stream_id", "pos", F.lit(side).alias("side"), "fields"))
    values = _values(lines, sides[0].unionByName(sides[1]), opened).distinct()
    record = ["stream_id", "pos", "record_id"]
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    # However often a record stands in the files, it has one row per side and field here.
    each = values.groupBy(*record, "side", "field").agg(total("h1").alias("h1"), total("h2").alias("h2"))
    shared = each.groupBy(*record).agg(
        F.bool_or(F.col("side") == 0).alias("old"),
        F.bool_or(F.col("side") == 1).alias("new"),
        F.collect_list(F.when(F.col("field").isNotNull(), F.struct("side", "field", "h1", "h2"))).alias("v"),
    )
    v = shared.filter("old and new").select("stream_id", "pos", F.explode("v").alias("v")).select("stream_id", "pos", "v.*")
    prints = v.groupBy("stream_id", "pos", "side", "field").agg(total("h1").alias("f1"), total("h2").alias("f2"))
    same = ["stream_id", "pos", "f1", "f2"]
    placed = prints.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "side").orderBy("field")))
    old = placed.filter("side = 0").select(*same, "nth", F.col("field").alias("old_name"))
    new = placed.filter("side = 1").select(*same, "nth", F.col("field").alias("new_name"))
    return old.join(new, [*same, "nth"]).select("stream_id", "pos", "old_name", "new_name")


@dataclass
class Drift:
    """``changes``: file_id, change, old_name, new_name. ``catalogue``: the lifespans' source, with stream_id and pos."""

    changes: DataFrame
    catalogue: DataFrame
    renamed: DataFrame


def drift(files: DataFrame, lines: DataFrame, write=None, opened: tuple[str, ...] = OPENED) -> Drift:
    """All changes of fields from each file to the next of its stream.

    ``write(df, name)`` keeps an intermediate table (by default in a run folder
    of its own), as each is used several times. ``opened`` names objects whose
    members count as fields, ``a.b`` one within another that is opened. Lines that are no JSON object are
    ignored, files without any such line have no fields, lines of unknown files
    count nowhere, and null values are no values. Files of the same
    ``file_seq`` follow each other by ``file_id``.
    """
    keep = write or RunFolder(files.sparkSession, "drift").write
    where = keep(positions(files), "positions")
    types = keep(catalogue(lines, opened).join(where, "file_id"), "catalogue")
    last = where.groupBy("stream_id").agg(F.max("pos").alias("last"))
    by_type = lifespans(types.select("stream_id", "field", "kind", "pos"), ["stream_id", "field", "kind"])
    logged = by_type.join(last, "stream_id")
    # A type that starts or ends between two files makes their sets of types differ.
    edges = keep(
        logged.filter("starts and pos > 1").select("stream_id", "pos", "field", F.lit(1).alias("start")).unionAll(
            logged.filter("ends and pos < last").select("stream_id", F.col("pos") + 1, "field", F.lit(0))
        ).groupBy("stream_id", "pos", "field").agg(F.max("start").alias("starts"), F.min("start").alias("s")).withColumn("ends", 1 - F.col("s")).drop("s"),
        "edges",
    )
    sets = types.groupBy("stream_id", "pos", "field").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    before = sets.select("stream_id", (F.col("pos") + 1).alias("pos"), "field", F.col("kinds").alias("old_kinds"))
    moved = keep(edges.join(sets.withColumnRenamed("kinds", "new_kinds"), ["stream_id", "pos", "field"], "left").join(before, ["stream_id", "pos", "field"], "left"), "moved")
    went, came = moved.filter("new_kinds is null"), moved.filter("old_kinds is null")
    renamed = keep(renames(lines, where, went, came, opened), "renamed")
    at = ["stream_id", "pos"]
    pairs = (
        renamed.join(went.select(*at, F.col("field").alias("old_name"), "old_kinds"), [*at, "old_name"])
        .join(came.select(*at, F.col("field").alias("new_name"), "new_kinds"), [*at, "new_name"])
        .select(*at, "old_name", "new_name", "old_kinds", "new_kinds")
    )
    row = lambda df, change: df.select(*at, F.lit(change).alias("change"), "old_name", "new_name")
    same = moved.filter("new_kinds is not null and old_kinds is not null").select(*at, F.col("field").alias("old_name"), F.col("field").alias("new_name"), "old_kinds", "new_kinds")
    lone = lambda df, name: df.select(*at, F.col("field").alias("old_name"), F.col("field").alias("new_name")).join(renamed.select(*at, name), [*at, name], "left_anti")
    changes = (
        row(renamed, "renamed")
        .unionByName(row(lone(went, "old_name"), "removed"))
        .unionByName(row(lone(came, "new_name"), "added"))
        .unionByName(row(same.unionByName(pairs).filter("old_kinds != new_kinds"), "type_changed"))
    )
    return Drift(changes.join(where, at).select("file_id", "change", "old_name", "new_name"), types, renamed)


MOST_FIELDS = 5_000  # names of fields that have columns of their own, the most common ones; all others stand in a map


def holding() -> Column:
    """The type that holds all values of a field with ``kinds`` and the flags of the catalogue; string if no other does."""
    only = lambda *k: F.size(F.array_except("kinds", F.array(*[F.lit(x) for x in k]))) == 0
    return (
        F.when(only("boolean"), "boolean")
        .when(F.col("all_integers") & only("integer", "string") | F.col("longs") & only("integer"), "bigint")
        .when(F.col("doubles") & only("integer", "number") & ~only("integer"), "double")
        .otherwise("string")
    )


def aliases(files: DataFrame, found: Drift, write) -> DataFrame:
    """``protocol, name, n_files, field, cast_to``: each name of a field with the field's usual name and the type that holds all values.

    Names belong to one field if a rename links them, directly or through
    others, in files of one protocol; the usual name is the one in most files,
    then the smallest. Names are few however many files there are.
    """
    kind = files.select(F.col("file_id").cast("bigint").alias("file_id"), F.coalesce("protocol", F.lit("")).alias("protocol"))
    c = found.catalogue.join(kind, "file_id")
    names = c.groupBy("protocol", F.col("field").alias("name")).agg(
        F.count_distinct("file_id").alias("n_files"), F.collect_set("kind").alias("kinds"), *[F.bool_and(f).alias(f) for f in FLAGS]
    )
    at = found.catalogue.select("stream_id", "pos", "file_id").distinct().join(kind, "file_id").select("stream_id", "pos", "protocol")
    links = found.renamed.join(at, ["stream_id", "pos"]).select(F.concat_ws("\n", "protocol", "old_name").alias("a"), F.concat_ws("\n", "protocol", "new_name").alias("b")).distinct()
    groups = smallest_labels(links, RunFolder(files.sparkSession, "aliases"))
    names = names.withColumn("v", F.concat_ws("\n", "protocol", "name")).join(groups, "v", "left").withColumn("label", F.coalesce("label", "v"))
    best = names.groupBy("label").agg(F.min(F.struct((-F.col("n_files")).alias("n"), "name"))["name"].alias("field"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"), *[F.bool_and(f).alias(f) for f in FLAGS])
    return names.select("protocol", "name", "n_files", "label").join(best.select("label", "field", holding().alias("cast_to")), "label").select("protocol", "name", "n_files", "field", "cast_to")


def consistent_table(files: DataFrame, lines: DataFrame, found: Drift, write, opened: tuple[str, ...] = OPENED, most: int = MOST_FIELDS) -> DataFrame:
    """One row per record: ``file_id, line_no`` and one column per field under its usual name, cast to the type that holds all values.

    A field that has different types in different protocols is a string. Trees
    are their JSON text. Lines that are no JSON object have no row, repeated
    lines one each. A field named like the two leading columns gets ``_`` behind.
    Of several names of one field in a record the first has the column; fields
    where that happens have another column, named ``_others``, with the rest as
    a JSON object of names and texts. Beyond ``most`` names the less common ones
    share one column more, ``_rest``, a map of their own names to texts.
    """
    table = write(aliases(files, found, write), "aliases")
    known = table.orderBy(F.col("n_files").desc(), "protocol", "name").limit(most + 1).select("protocol", "name", "field", "cast_to").collect()
    with_rest = len(known) > most
    known = known[:most]
    types: dict[str, set] = {}
    for r in known:
        types.setdefault(r.field, set()).add(r.cast_to)
    fields = sorted(types)
    number = {f: i for i, f in enumerate(fields)}
    place = {(r.protocol, r.name): number[r.field] for r in known}
    column = lambda f: f + "_" if f in ("file_id", "line_no", "_rest") else f
    protocol = files.select(F.col("file_id").cast("bigint").alias("file_id"), F.coalesce("protocol", F.lit("")).alias("protocol"))
    source = lines.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), F.col("line").cast("string").alias("line")).join(protocol, "file_id")
    schema = ", ".join(["file_id bigint", "line_no int", *[f"c{i} string" for i in range(len(fields))], "more string", "_rest map<string,string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            cols: list[list] = [[] for _ in fields]
            more: list = []
            rest: list = []
            for i, (line, kind) in enumerate(zip(batch.column("line").to_pylist(), batch.column("protocol").to_pylist())):
                record = fields_of(line, opened)
                if record is None:
                    continue
                rows.append(i)
                rest.append([])
                for c in cols:
                    c.append(None)
                others: dict[int, dict] = {}
                for name in sorted(record):
                    v, at = record[name], place.get((kind, _utf8(name)))
                    if v is None:
                        continue
                    if at is None:
                        rest[-1].append((_utf8(name), _utf8(text_of(v))))
                    elif cols[at][-1] is None:
                        cols[at][-1] = _utf8(text_of(v))
                    else:
                        others.setdefault(at, {})[_utf8(name)] = _utf8(text_of(v))
                more.append(json.dumps(others) if others else None)
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column("file_id").take(take), batch.column("line_no").take(take), *[pa.array(c, pa.string()) for c in [*cols, more]], pa.array(rest, pa.map_(pa.string(), pa.string()))], names=["file_id", "line_no", *[f"c{i}" for i in range(len(fields))], "more", "_rest"])

    wide = write(source.mapInArrow(run, schema), "wide")
    shared = sorted(int(r[0]) for r in wide.filter("more is not null").select(F.explode(F.json_object_keys("more"))).distinct().collect())
    taken, rest = {column(f) for f in fields}, ["_rest"] if with_rest else []
    for i in shared:
        name = column(fields[i]) + "_others"
        while name in taken:
            name += "_"
        taken.add(name)
        rest.append(F.get_json_object("more", f"$.{i}").alias(name))
    return wide.select("file_id", "line_no", *[F.col(f"c{i}").try_cast(next(iter(types[f])) if len(types[f]) == 1 else "string").alias(column(f)) for i, f in enumerate(fields)], *rest)
