import collections
import json

from sigtrace.operators.drift import consistent_table, drift
from sigtrace.plans.records import p5_found, p5_table
from sigtrace.sources.shared import RunFolder

FILES = "file_id long, stream_id long, file_seq int"
LINES = "file_id long, line_no int, line string"


def brute(files, lines):
    cat, recs = collections.defaultdict(lambda: collections.defaultdict(set)), collections.defaultdict(dict)
    for fid, _, x in lines:
        try:
            r = json.loads(x)
        except (ValueError, TypeError):
            continue
        if not isinstance(r, dict):
            continue
        o = {}
        for k, v in r.items():
            o.update({f"transport.{a}": b for a, b in v.items()} if k == "transport" and isinstance(v, dict) else {k: v})
        for k, v in o.items():
            if v is not None:
                cat[fid][k].add(type(v).__name__)
        recs[fid][o.get("record_id")] = o
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    out = []
    streams = collections.defaultdict(list)
    for fid, s, q in files:
        streams[s].append((q, fid))
    for q in streams.values():
        ids = [f for _, f in sorted(q)]
        for a, b in zip(ids, ids[1:]):
            old, new = cat[a], cat[b]
            went, came, used = sorted(set(old) - set(new)), sorted(set(new) - set(old)), set()
            shared = (set(recs[a]) & set(recs[b])) - {None}
            for x in went:
                for y in came:
                    v = [(recs[a][i].get(x), recs[b][i].get(y)) for i in shared]
                    if y not in used and any(u is not None for u, _ in v) and all((u is None) == (w is None) and (u is None or text(u) == text(w)) for u, w in v):
                        out.append((b, "renamed", x, y))
                        used |= {x, y}
                        if old[x] != new[y]:
                            out.append((b, "type_changed", x, y))
                        break
            out += [(b, "removed", x, x) for x in went if x not in used] + [(b, "added", y, y) for y in came if y not in used]
            out += [(b, "type_changed", k, k) for k in set(old) & set(new) if old[k] != new[k]]
    return sorted(out)


def found(df):
    return sorted((r.file_id, r.change, r.old_name, r.new_name) for r in df.collect())


def test_small_streams(spark):
    files = [(1, 7, 1), (2, 7, 2), (3, 7, 3), (4, 7, 4), (5, 8, 1), (6, 8, 9), (9, 9, 1)]
    lines = [
        (1, 1, '{"record_id":"r","a":1,"transport":{"x":"q"},"n":null}'), (1, 2, "not json"), (1, 3, None), (1, 4, "[]"), (1, 5, '{"record_id":"s","a":2,"transport":{"x":"p"}}'),
        (2, 1, '{"record_id":"s","b":"2","transport":{"y":"p","z":1}}'), (2, 2, '{"record_id":"s","b":"2","transport":{"y":"p","z":1}}'), (2, 3, "  "),
        (4, 1, '{"record_id":"s","b":1.5,"c":true}'), (5, 1, '{"a":1}'), (6, 1, '{"a":"1","b":1}'), (77, 1, '{"u":1}'),
    ]
    got = drift(spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)).changes
    want = brute(files, lines)
    assert found(got) == want and (2, "renamed", "a", "b") in want and (2, "type_changed", "a", "b") in want


def test_against_brute_force(spark, data):
    f = [(r.file_id, r.stream_id, r.file_seq) for r in spark.read.parquet(f"{data}/raw_files.parquet").collect()]
    x = [(r.file_id, r.line_no, r.line) for r in spark.read.parquet(f"{data}/raw_lines.parquet").collect()]
    assert found(p5_found(spark, data)) == brute(f, x) != []


def test_empty(spark):
    assert drift(spark.createDataFrame([], FILES), spark.createDataFrame([], LINES)).changes.count() == 0


def test_one_consistent_table(spark, data):
    files = spark.createDataFrame([(1, 7, 1, "P"), (2, 7, 2, "P"), (3, 8, 1, "N")], FILES + ", protocol string")
    lines = spark.createDataFrame(
        [(1, 1, '{"record_id":"r","a":1,"t":{"x":[1]}}'), (1, 2, '{"record_id":"s","a":2}'), (1, 3, "broken"), (2, 1, '{"record_id":"s","b":"2","file_id":1.5,"t":null}'), (3, 1, '{"b":true}')], LINES
    )
    folder = RunFolder(spark, "t")
    got = consistent_table(files, lines, drift(files, lines, folder.write), folder.write)
    assert dict(got.dtypes) == {"file_id": "bigint", "line_no": "int", "a": "bigint", "b": "boolean", "file_id_": "double", "record_id": "string", "t": "string"}
    rows = [(r.file_id, r.line_no, r.a, r.b, r.file_id_, r.record_id, r.t) for r in got.orderBy("file_id", "line_no").collect()]
    assert rows == [(1, 1, 1, None, None, "r", '{"x":[1]}'), (1, 2, 2, None, None, "s", None), (2, 1, 2, None, 1.5, "s", None), (3, 1, None, True, None, None, None)]
    table = p5_table(spark, data)
    kept = spark.read.parquet(f"{data}/raw_lines.parquet").count()
    assert kept * 0.9 < table.count() <= kept and "transport_src_ip" in table.columns and "transport_sport" not in table.columns


def test_table_keeps_large_numbers_and_second_names(spark):
    files = spark.createDataFrame([(1, 7, 1, "P"), (2, 7, 2, "P")], FILES + ", protocol string")
    lines = spark.createDataFrame(
        [
            (1, 1, '{"record_id":"r","old":"x","big":18446744073709551615,"most":9223372036854775807,"fine":0.1234567890123456789,"sum":0.30000000000000004,"mixed":9007199254740993}'),
            (2, 1, '{"record_id":"r","new":"x","big":1,"most":-9223372036854775808,"fine":1,"sum":2,"mixed":0.5}'),
            (2, 2, '{"record_id":"s","new":"y","old":"z"}'),
            (1, 2, '{"record_id":"t","old":"v","new":"w"}'),
        ],
        LINES,
    )
    folder = RunFolder(spark, "t")
    found = drift(files, lines, folder.write)
    # a rename as if the names followed each other, so that one record holds both
    found.renamed = spark.createDataFrame([(7, 2, "old", "new")], "stream_id long, pos int, old_name string, new_name string")
    got = consistent_table(files, lines, found, folder.write)
    kinds = dict(got.dtypes)
    assert {c: kinds[c] for c in ("big", "most", "fine", "sum", "mixed")} == {"big": "string", "most": "bigint", "fine": "string", "sum": "double", "mixed": "string"}
    rows = {(r.file_id, r.line_no): r for r in got.collect()}
    a, b = rows[1, 1], rows[2, 1]
    assert (a.big, a.most, a.fine, a["sum"], a.mixed) == ("18446744073709551615", (1 << 63) - 1, "0.1234567890123456789", 0.30000000000000004, "9007199254740993")
    assert (b.big, b.most, b.fine, b["sum"], b.mixed) == ("1", -(1 << 63), "1", 2.0, "0.5")
    assert {k: (r.new, r.new_others and json.loads(r.new_others)) for k, r in rows.items()} == {(1, 1): ("x", None), (2, 1): ("x", None), (2, 2): ("y", {"old": "z"}), (1, 2): ("w", {"old": "v"})}


def test_opened_objects_and_names_beyond_the_bound(spark):
    """Objects to open are named by the caller; beyond the bound of names the rest stands in a map, nothing is lost."""
    schema = FILES + ", protocol string"
    files = spark.createDataFrame([(1, 1, 1, "P"), (2, 1, 2, "P")], schema)
    lines = spark.createDataFrame([(1, 1, '{"record_id":"r","m":{"x":1,"y":{"z":"q"}},"rare":5}'), (2, 1, '{"record_id":"r","m":{"w":1,"y":{"z":"q"}}}'), (2, 2, '{"record_id":"r","m":{"w":1,"y":{"z":"q"}}}')], LINES)
    folder = RunFolder(spark, "t")
    opened = ("m", "m.y")
    got = drift(files, lines, folder.write, opened)
    assert found(got.changes) == [(2, "removed", "rare", "rare"), (2, "renamed", "m.x", "m.w")]
    whole = consistent_table(files, lines, got, folder.write, opened)
    assert {"record_id", "m.w", "m.y.z", "rare"} <= set(whole.columns) and "_rest" not in whole.columns
    part = consistent_table(files, lines, got, folder.write, opened, most=2)
    assert set(part.columns) == {"file_id", "line_no", "record_id", "m.y.z", "_rest"}
    assert sorted(((r.file_id, r.line_no, dict(r._rest)) for r in part.collect())) == [(1, 1, {"m.x": "1", "rare": "5"}), (2, 1, {"m.w": "1"}), (2, 2, {"m.w": "1"})]


def test_one_record_many_times(spark):
    """A record id with most rows, of several values each, is reduced before its fields are compared."""
    files = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], FILES)
    rows = [(f, i, json.dumps({"record_id": "same", "a" if f == 1 else "b": str(i % 7)})) for f in (1, 2) for i in range(400)]
    assert found(drift(files, spark.createDataFrame(rows, LINES)).changes) == [(2, "renamed", "a", "b")]
    other = [(f, i, json.dumps({"record_id": "same", "a" if f == 1 else "b": str(i % (6 + f))})) for f in (1, 2) for i in range(400)]
    assert found(drift(files, spark.createDataFrame(other, LINES)).changes) == [(2, "added", "b", "b"), (2, "removed", "a", "a")]
