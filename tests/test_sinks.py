import hashlib
import json
import os

import pytest

from sigtrace.sources.registry import canonical_digest, load_registry
from sigtrace.sources.sinks import digest_of, publish, verify, write_document, write_documents, write_lines


def test_lines_documents_and_index(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", None), (1, "a", 1.5), (2, "é", 2.0), (1, "a", 1.5)], "id int, s string, v double")
    got = write_lines(df, str(tmp_path / "lines"), ["id"])
    lines = [x for n in sorted(got["files"]) for x in (tmp_path / "lines" / n).read_text().splitlines()]
    assert got["lines"] == 4 and [json.loads(x)["id"] for x in lines] == [1, 1, 2, 3] and lines[3] == '{"id":3,"s":"c","v":null}'
    assert all(hashlib.sha256((tmp_path / "lines" / n).read_bytes()).hexdigest() == h for n, h in got["files"].items())
    assert write_lines(df, str(tmp_path / "again"), ["id"])["digest"] == got["digest"]
    assert write_lines(df.limit(0), str(tmp_path / "none"), ["id"])["lines"] == 0
    h = write_document(spark, str(tmp_path / "d.json"), {"b": [1], "a": "ü"})
    assert hashlib.sha256((tmp_path / "d.json").read_bytes()).hexdigest() == h and list(json.loads((tmp_path / "d.json").read_text())) == ["a", "b"] and not (tmp_path / "d.json.part").exists()
    docs = spark.createDataFrame([("x", '{"k":1}'), ("y", "é"), ("z", None)], "id string, doc string")
    index = {r.id: r for r in write_documents(docs, str(tmp_path / "docs"), "id", "doc", 4).collect()}
    assert index["y"].n_bytes == 2 and index["x"].sha256 == hashlib.sha256(b'{"k":1}').hexdigest() and index["z"].sha256 is None
    assert spark.read.parquet(str(tmp_path / "docs" / "documents")).count() == 3


def test_published_tables_are_checked(spark, tmp_path):
    t = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    m = publish({"t": t}, str(tmp_path / "out"))
    assert m["tables"]["t"]["rows"] == 3 and m["tables"]["t"]["digest"] == digest_of(t) and verify(spark, str(tmp_path / "out")) == {"t": True}
    t.limit(2).write.mode("overwrite").parquet(str(tmp_path / "out" / "t"))
    assert verify(spark, str(tmp_path / "out")) == {"t": False}


def test_registries(tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"profile_id":"b","release":"17"}')
    (tmp_path / "r" / "c.json").write_text('[{"profile_id":"a","release":"17"}]')
    got = load_registry(str(tmp_path / "r"), ["a.json", "c.json"], "profile_id", ("release",), inline=[{"profile_id": "z", "release": "17"}])
    assert [e["profile_id"] for e in got.entries] == ["a", "b", "z"] and got.digest == canonical_digest(got.entries)
    assert load_registry(str(tmp_path / "r"), ["c.json", "a.json"], "profile_id", digests=got.files).files == got.files
    (tmp_path / "x.json").write_text("{}")
    os.symlink(tmp_path / "x.json", tmp_path / "r" / "l.json")
    for bad in (["../x.json"], ["l.json"], [str(tmp_path / "x.json")]):
        with pytest.raises(ValueError):
            load_registry(str(tmp_path / "r"), bad, "profile_id")
    for options in ({"digests": {"a.json": "0"}}, {"inline": [{"profile_id": "b"}]}, {"inline": [{"release": "18", "profile_id": "q"}], "same": ("release",)}, {"inline": [{}]}):
        with pytest.raises(ValueError):
            load_registry(str(tmp_path / "r"), ["a.json"], "profile_id", **options)
