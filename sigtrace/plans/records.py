"""Queries p3, p4 and p5: nested records, repeated deliveries, drifting schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.functions.numbers import number_text
from sigtrace.operators.drift import Drift, consistent_table, drift
from sigtrace.operators.nested import NodeTables, nodes, type_path, within
from sigtrace.sources.shared import RunFolder
from sigtrace.streaming.dedup import deduplicate_files


def pfcp_key() -> list[Column]:
    """What makes two rows of ``pfcp_messages`` the same message."""
    return [F.col("analysis_id"), F.col("frame"), number_text(F.col("seq_num")), number_text(F.col("seid"))]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_files(spark, f"{sf_dir}/pfcp_messages.parquet", pfcp_key(), "received_at", "row_id").dropped


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one copy of each message that stays."""
    return deduplicate_files(spark, f"{sf_dir}/pfcp_messages.parquet", pfcp_key(), "received_at", "row_id").kept


def tree_nodes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The nodes of all trees: of PFCP and NGAP messages and of HTTP/2 bodies."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pfcp = nodes(read("pfcp_messages"), ["row_id"], {"pfcp": F.col("pfcp")}, **options)
    ngap = nodes(read("ngap_messages"), ["row_id"], {"ngap": F.col("ngap")}, **options)
    http = nodes(read("http2_streams"), ["row_id"], {"request_body": F.col("request.body.decoded_json"), "response_body": F.col("response.body.decoded_json")}, **options)
    return pfcp.unionByName(ngap).unionByName(http)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_nodes(spark, sf_dir, columns=("field_name", "object_path", "parent_path"), root=False)


def p3_node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node tables' types, over objects, arrays and scalars: how many nodes and records each has."""
    n = tree_nodes(spark, sf_dir, kinds=("object", "array", "scalar"), columns=("field_name", "kind", "level", "object_path"))
    return n.groupBy("field_name", "kind", type_path(F.col("object_path")).alias("node_type")).agg(F.count("*").alias("n_nodes"), F.max("level").alias("deepest"))


LABELS = ("field_name", "kind", "pre", "post", "level", "object_path", "parent_pre", "value", "members")


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the tables per node type, over objects, arrays and scalars: labels, the parent's label, pointer, a scalar's value and an object's scalar members (as JSON text)."""
    folder = RunFolder(spark, "nodes")
    tables = NodeTables(tree_nodes(spark, sf_dir, kinds=("object", "array", "scalar"), columns=LABELS), f"{folder.path}/tables", ["row_id"])
    return tables.all.withColumn("members", F.to_json("members"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each object of an array how many objects lie inside it, and how deep the deepest, by interval containment."""
    n = RunFolder(spark, "nodes").write(tree_nodes(spark, sf_dir, columns=("field_name", "pre", "post", "level", "object_path")), "nodes")
    items = n.filter(F.col("object_path").rlike("/[0-9]+$"))
    inside = within(n, items, ["row_id"])
    return inside.groupBy("field_name", "row_id", F.col("outer_pre").alias("pre"), F.col("outer_object_path").alias("object_path")).agg(F.count("*").alias("n_inside"), F.max(F.col("level") - F.col("outer_level")).alias("deepest"))


def file_drift(spark: SparkSession, sf_dir: str) -> Drift:
    folder = RunFolder(spark, "drift")
    return drift(spark.read.parquet(f"{sf_dir}/raw_files.parquet"), spark.read.parquet(f"{sf_dir}/raw_lines.parquet"), folder.write)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_drift(spark, sf_dir).changes


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one table of consistent columns."""
    folder = RunFolder(spark, "drift")
    files, lines = spark.read.parquet(f"{sf_dir}/raw_files.parquet"), spark.read.parquet(f"{sf_dir}/raw_lines.parquet")
    table = consistent_table(files, lines, drift(files, lines, folder.write), folder.write)
    return table.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in table.columns])


QUERIES = {"p5_found": p5_found, "p5_table": p5_table, "p3_found": p3_found, "p3_node_types": p3_node_types, "p3_tables": p3_tables, "p3_links": p3_links, "p4_found": p4_found, "p4_kept": p4_kept}

# A string counts as the tree that it holds, at any level. The labels of p3_tables and p3_links are tested by brute force.
_TREE = "CASE WHEN json_valid({0}) THEN CASE WHEN json_type({0}) IN ('OBJECT', 'ARRAY') THEN CAST({0} AS JSON) WHEN json_type({0}) = 'VARCHAR' AND json_valid({0}->>'$') AND regexp_matches({0}->>'$', '^[ \\t\\n\\r]*[{{\\[]') THEN CAST({0}->>'$' AS JSON) END END"
_NODES = f"""
    WITH RECURSIVE t AS (
        SELECT 'pfcp' AS field_name, row_id, {_TREE.format("pfcp")} AS j FROM pfcp_messages UNION ALL SELECT 'ngap', row_id, {_TREE.format("ngap")} FROM ngap_messages
        UNION ALL SELECT 'request_body', row_id, {_TREE.format("request.body.decoded_json")} FROM http2_streams UNION ALL SELECT 'response_body', row_id, {_TREE.format("response.body.decoded_json")} FROM http2_streams
    ), n AS (
        SELECT field_name, row_id, j, '' AS path, '' AS parent, '' AS around, json_type(j) AS kind FROM t WHERE j IS NOT NULL
        UNION ALL
        SELECT field_name, row_id, c.j, c.path, c.around, CASE WHEN json_type(c.j) = 'OBJECT' THEN c.path ELSE c.around END, json_type(c.j) FROM (
            SELECT n.field_name, n.row_id, n.around, n.path || '/' || replace(replace(e.key, '~', '~0'), '/', '~1') AS path, {_TREE.format("e.value")} AS j FROM n, json_each(n.j) e
        ) c WHERE c.j IS NOT NULL
    )
    SELECT field_name, row_id, path AS object_path, parent AS parent_path FROM n WHERE path <> '' AND kind = 'OBJECT'
"""

_COPIES = """
    WITH t AS (
        SELECT row_id, received_at, analysis_id, frame, trim(seq_num) AS s, trim(seid) AS e FROM pfcp_messages
    ), n AS (
        SELECT row_id, received_at, analysis_id, frame,
            CASE WHEN s ILIKE '0x%' THEN CAST(lower(s) AS UBIGINT) ELSE TRY_CAST(s AS UBIGINT) END AS seq,
            CASE WHEN e ILIKE '0x%' THEN CAST(lower(e) AS UBIGINT) ELSE TRY_CAST(e AS UBIGINT) END AS sei
        FROM t
    ), c AS (
        SELECT row_id, row_number() OVER (PARTITION BY analysis_id, frame, seq, sei ORDER BY received_at, row_id) AS k FROM n
    )
"""

# The definition itself: sets of (record, value) over the records that both files hold are compared as lists.
_FIELDS = """
    WITH pos AS (
        SELECT file_id, stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY file_seq, file_id) AS pos FROM raw_files
    ), l AS (
        SELECT DISTINCT file_id, line FROM raw_lines WHERE CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END
    ), top AS (
        SELECT file_id, line, e.key AS field, e.type AS type, e.value AS value FROM l, json_each(l.line) e
    ), kv AS (
        SELECT file_id, line, field, type, value FROM top WHERE NOT (field = 'transport' AND type = 'OBJECT')
        UNION ALL SELECT file_id, line, 'transport.' || e.key, e.type, e.value FROM (SELECT * FROM top WHERE field = 'transport' AND type = 'OBJECT') t, json_each(t.value) e
    ), v AS (
        SELECT file_id, field, json_extract_string(line, '$.record_id') AS rid,
            CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS kind,
            CASE WHEN type = 'VARCHAR' THEN value->>'$' ELSE CAST(value AS VARCHAR) END AS text
        FROM kv WHERE type <> 'NULL'
    ), kinds AS (
        SELECT p.stream_id, p.pos, v.field, list_sort(list(DISTINCT v.kind)) AS kinds FROM v JOIN pos p USING (file_id) GROUP BY ALL
    ), pair AS (
        SELECT b.stream_id, b.pos, a.file_id AS old_file, b.file_id AS new_file FROM pos a JOIN pos b ON a.stream_id = b.stream_id AND b.pos = a.pos + 1
    ), both_kinds AS (
        SELECT pair.*, coalesce(o.field, n.field) AS field, o.kinds AS old_kinds, n.kinds AS new_kinds
        FROM pair JOIN (SELECT DISTINCT pair.pos, pair.stream_id, k.field FROM pair JOIN kinds k ON k.stream_id = pair.stream_id AND k.pos IN (pair.pos, pair.pos - 1)) f ON f.stream_id = pair.stream_id AND f.pos = pair.pos
        LEFT JOIN kinds o ON o.stream_id = pair.stream_id AND o.pos = pair.pos - 1 AND o.field = f.field LEFT JOIN kinds n ON n.stream_id = pair.stream_id AND n.pos = pair.pos AND n.field = f.field
    ), shared AS (
        SELECT pair.new_file, a.rid FROM pair JOIN (SELECT DISTINCT file_id, rid FROM v) a ON a.file_id = pair.old_file JOIN (SELECT DISTINCT file_id, rid FROM v) b ON b.file_id = pair.new_file AND b.rid = a.rid
    ), sets AS (
        SELECT c.new_file, c.field, c.old_kinds IS NOT NULL AS old, list_sort(list(DISTINCT v.rid || chr(1) || v.text)) AS vals FROM both_kinds c
        JOIN v ON v.file_id = CASE WHEN c.old_kinds IS NOT NULL THEN c.old_file ELSE c.new_file END AND v.field = c.field JOIN shared s ON s.new_file = c.new_file AND s.rid = v.rid
        WHERE (c.old_kinds IS NULL) <> (c.new_kinds IS NULL) GROUP BY ALL
    ), nth AS (
        SELECT *, row_number() OVER (PARTITION BY new_file, old, vals ORDER BY field) AS n FROM sets
    ), renamed AS (
        SELECT a.new_file, a.field AS old_name, b.field AS new_name FROM nth a JOIN nth b ON a.new_file = b.new_file AND a.vals = b.vals AND a.n = b.n AND a.old AND NOT b.old
    )
    SELECT new_file AS file_id, 'renamed' AS change, old_name, new_name FROM renamed
    UNION ALL SELECT new_file, 'removed', field, field FROM both_kinds c WHERE new_kinds IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.new_file = c.new_file AND r.old_name = c.field)
    UNION ALL SELECT new_file, 'added', field, field FROM both_kinds c WHERE old_kinds IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.new_file = c.new_file AND r.new_name = c.field)
    UNION ALL SELECT new_file, 'type_changed', field, field FROM both_kinds WHERE old_kinds <> new_kinds
    UNION ALL SELECT r.new_file, 'type_changed', old_name, new_name FROM renamed r JOIN both_kinds a ON a.new_file = r.new_file AND a.field = r.old_name JOIN both_kinds b ON b.new_file = r.new_file AND b.field = r.new_name WHERE a.old_kinds <> b.new_kinds
"""

ORACLE: dict[str, str] = {"p3_found": _NODES, "p5_found": _FIELDS, "p4_found": _COPIES + "SELECT row_id FROM c WHERE k > 1", "p4_kept": _COPIES + "SELECT row_id FROM c WHERE k = 1"}
