import json

import pytest
from pyspark.sql import functions as F

from sigtrace.functions import trees
from sigtrace.operators.nested import nodes, within
from sigtrace.plans.records import tree_nodes

TEXTS = ['{"a":[1,{"b":"{\\"c\\":{}}"}],"~/":{}, "":{"x":[]}}', "[]", '"[{}]"', '"x"', "3", "", '{"a":1', "[1,]", '{"a" 1}', "NaN", "[NaN]", '{"a":{},"a":[{}]}', '[1e5,-0.5,12345678901234567890,true,null,"\\ud800"]', ' {"a" : [ ] } ', "[[],[[]],{}]", "{,}", '{"a":1,}', "[1 2]", "[}", '"a" "b"', "1" * 5000, '{"é":{"日本":{}}}']


def parsed(f, s):
    try:
        return f(s)
    except ValueError:
        return "invalid"


@pytest.mark.parametrize("s", TEXTS)
def test_parser_without_recursion(s):
    assert parsed(trees._deep, s) == parsed(trees._strict.decode, s)


def walk(text, field):
    """Plain recursion over the same definition."""
    out = []

    def visit(v, path, parent):
        if isinstance(v, str) and v.lstrip(" \t\n\r")[:1] in ("{", "["):
            try:
                v = json.loads(v)
            except ValueError:
                return
        if isinstance(v, dict):
            if path:
                out.append((field, path, parent))
            for k, c in v.items():
                visit(c, path + "/" + k.replace("~", "~0").replace("/", "~1"), path)
        elif isinstance(v, list):
            for i, c in enumerate(v):
                visit(c, f"{path}/{i}", parent)

    if text:
        try:
            visit(json.loads(text), "", "")
        except ValueError:
            pass
    return out


def test_objects_and_parents(spark):
    texts = [t for t in TEXTS if "NaN" not in t] + [None, None, '{"a":{}}', '{"a":{}}']
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id long, tree string, kind_of string")
    got = nodes(df, ["row_id"], {"tree": F.col("tree")}, columns=("field_name", "object_path", "parent_path"), root=False)
    assert sorted((r.field_name, r.row_id, r.object_path, r.parent_path) for r in got.collect()) == sorted((f, i, p, q) for i, t in enumerate(texts) for f, p, q in walk(t, "tree"))


def test_intervals_give_the_ancestors(spark, data):
    n = tree_nodes(spark, data, columns=("field_name", "pre", "post", "level", "object_path", "parent_pre"))
    pairs = within(n, n, ["row_id"])
    bad = pairs.filter(~F.col("object_path").startswith(F.concat("outer_object_path", F.lit("/"))))
    assert pairs.count() > 1000 and bad.count() == 0
    near = pairs.groupBy("field_name", "row_id", "pre", "parent_pre").agg(F.max("outer_pre").alias("nearest"))
    assert near.filter("nearest != parent_pre").count() == 0


def test_deep_and_empty(spark):
    deep = "[" * 50_000 + '{"a":{}}' + "]" * 50_000
    objects = '{"a":' * 2000 + "1" + "}" * 2000
    df = spark.createDataFrame([(1, deep), (2, objects)], "row_id long, t string")
    got = {r.row_id: r["count"] for r in nodes(df, ["row_id"], {"t": F.col("t")}, root=False).groupBy("row_id").count().collect()}
    assert got == {1: 2, 2: 1999}
    assert nodes(df.limit(0), ["row_id"], {"t": F.col("t")}).count() == 0
    with pytest.raises(ValueError):
        nodes(df.withColumnRenamed("row_id", "pre"), ["pre"], {"t": F.col("t")})


def test_scalars_keep_their_text(spark):
    df = spark.createDataFrame([(1, '{"a":[1.50,true,null,"x"]}')], "row_id long, t string")
    got = nodes(df, ["row_id"], {"t": F.col("t")}, kinds=("object", "array", "scalar")).orderBy("pre").collect()
    assert [(r.kind, r.object_path, r.value, r.pre, r.post) for r in got] == [("object", "", None, 0, 5), ("array", "/a", None, 1, 4), ("scalar", "/a/0", "1.50", 2, 0), ("scalar", "/a/1", "true", 3, 1), ("scalar", "/a/2", None, 4, 2), ("scalar", "/a/3", "x", 5, 3)]


def test_tables_per_type_are_linked_by_labels(spark, tmp_path):
    from sigtrace.operators.nested import ROOT, NodeTables

    texts = ['{"id":"7","list":[{"n":1,"on":true,"x":null},{"n":"2.5","sub":{"k":"v"}}]}', '{"list":[{"n":"many"}]}', "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, t string")
    found = nodes(df, ["row_id"], {"t": F.col("t")}, columns=("field_name", "pre", "post", "level", "object_path", "parent_pre", "members"))
    tables = NodeTables(found, str(tmp_path / "tables"), ["row_id"], ranges=3)
    assert {(r.node_type, r.n_nodes) for r in tables.types().collect()} == {(ROOT, 2), ("/list/*", 3), ("/list/*/sub", 1)}
    items = tables.table("t", "/list/*", {"n": "double", "on": "boolean", "x": "string"})
    assert sorted(((r.row_id, r.n, r.on, r.x) for r in items.collect()), key=str) == [(0, 1.0, True, None), (0, 2.5, None, None), (1, None, None, None)]
    roots, subs = tables.table("t", ROOT, {"id": "int"}), tables.table("t", "/list/*/sub", {"k": "string"})
    one = lambda df: df.withColumn("field_name", F.lit("t"))
    assert [(r.k, r.outer_n) for r in within(one(subs), one(items), ["row_id"]).collect()] == [("v", 2.5)]
    assert [(r.k, r.outer_id) for r in within(one(subs), one(roots), ["row_id"], width=1).collect()] == [("v", 7)]
    assert NodeTables(found.limit(0), str(tmp_path / "none"), ["row_id"]).all.count() == 0


def test_links_count_what_lies_inside(spark, data):
    from sigtrace.plans.records import p3_links

    n = tree_nodes(spark, data, columns=("field_name", "pre", "object_path")).collect()
    want = {}
    for r in n:
        parts = r.object_path.split("/")
        for k in range(2, len(parts)):
            if parts[k - 1].isdigit():
                key = (r.field_name, r.row_id, "/".join(parts[:k]))
                want[key] = want.get(key, 0) + 1
    there = {(r.field_name, r.row_id, r.object_path) for r in n}
    assert {(r.field_name, r.row_id, r.object_path): r.n_inside for r in p3_links(spark, data).collect()} == {k: v for k, v in want.items() if k in there}


def test_tables_hold_every_node(spark, data, tmp_path):
    """Arrays, their scalars and nulls too; a pointer may be longer than a file name."""
    from sigtrace.operators.nested import ROOT, NodeTables
    from sigtrace.plans.records import LABELS, p3_node_types, p3_tables

    long = "k" * 300
    texts = ['{"ids":["a",2,null],"none":null,"empty":[],"' + long + '":{"x":"{\\"y\\":[true]}"}}', "[1,[]]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, t string")
    tables = NodeTables(nodes(df, ["row_id"], {"t": F.col("t")}, kinds=("object", "array", "scalar"), columns=LABELS), str(tmp_path / "tables"), ["row_id"])
    got = {(r.row_id, r.pre, r.kind, r.object_path, r.value) for r in tables.all.collect()}
    first = [("object", "", None), ("array", "/ids", None), ("scalar", "/ids/0", "a"), ("scalar", "/ids/1", "2"), ("scalar", "/ids/2", None), ("scalar", "/none", None), ("array", "/empty", None)]
    first += [("object", f"/{long}", None), ("object", f"/{long}/x", None), ("array", f"/{long}/x/y", None), ("scalar", f"/{long}/x/y/0", "true")]
    second = [("array", "", None), ("scalar", "/0", "1"), ("array", "/1", None)]
    assert got == {(i, pre, *n) for i, t in enumerate((first, second)) for pre, n in enumerate(t)}
    assert [r.members for r in tables.all.filter("kind = 'object' and pre = 0").collect()] == [{"none": None}]
    ids = tables.table("t", "/ids/*", {"id": "int"}, kind="scalar")
    assert {(r.pre, r.parent_pre, r.id) for r in ids.collect()} == {(2, 0, None), (3, 0, 2), (4, 0, None)}
    assert tables.table("t", ROOT, {}, kind="array").count() == 1

    name = F.when(F.col("node_type") == "", ROOT).otherwise(F.col("node_type")).alias("node_type")
    want = p3_node_types(spark, data).select("field_name", "kind", name, "n_nodes", "deepest")
    have = p3_tables(spark, data).groupBy("field_name", "kind", "node_type").agg(F.count("*").alias("n_nodes"), F.max("level").alias("deepest"))
    assert {tuple(r) for r in have.collect()} == {tuple(r) for r in want.collect()}
