"""Files, logs and sinks through Spark's readers and writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quernstone.sources import files, sinks, tables


def test_upload_types_and_problems(spark, tmp_path):
    good = {"a.png": bytes.fromhex("89504E470D0A1A0A") + b"x", "b.jpg": b"\xff\xd8\xff\xe0", "c.pdf": b"%PDF-1.7", "d.webp": b"RIFF0000WEBPVP8 ", "e.heic": b"\0\0\0\x18ftypheic", "f.txt": b"hello", "g.png": b""}
    (tmp_path / "up").mkdir()
    for name, content in good.items():
        (tmp_path / "up" / name).write_bytes(content)
    out = {r.path.rsplit("/", 1)[1]: (r.kind, r.problem) for r in files.uploads(spark, str(tmp_path / "up")).collect()}
    assert out == {"a.png": ("png", None), "b.jpg": ("jpeg", None), "c.pdf": ("pdf", None), "d.webp": ("webp", None), "e.heic": ("heic", None), "f.txt": (None, "unknown_type")}
    sizes = files.folder_sizes(spark, str(tmp_path / "up")).first()
    assert (sizes.files, sizes.bytes) == (6, sum(map(len, good.values())))
    listed = files.manifest(spark, str(tmp_path / "up"))
    assert listed.count() == 6
    lost = files.orphans(spark, str(tmp_path / "up"), listed.filter(F.col("path").endswith("a.png")), "path", F.lit(dt.datetime(2100, 1, 1)))
    assert lost.count() == 5


def test_log_reader(spark, tmp_path):
    lines = [json.dumps({"id": "1", "ts": "2024-01-01T10:00:00Z", "level": "error", "message": "token=abc", "extra": {"apiKey": "k", "n": "1"}}), "", "broken {", json.dumps({"ts": "no time", "message": "x"}), json.dumps({"ts": "2024-01-02T10:00:00Z", "message": "old style"})]
    (tmp_path / "app.log").write_text("\n".join(lines))
    (tmp_path / "app.log.1").write_text(json.dumps({"id": "9", "ts": "2023-01-01T00:00:00Z", "message": "archived"}))
    (tmp_path / "app.log.bak").write_text(lines[0])
    log = files.read_log(spark, str(tmp_path))
    out = {r.message: r for r in log.collect()}
    assert set(out) == {"token=abc", "old style", "archived"}
    assert out["old style"].id.startswith("legacy_") and len(out["old style"].id) == 31
    clean = {r.message: r.extra for r in sinks.redacted_bundle(log).collect()}
    assert clean["token=[redacted]"] == {"apiKey": "[redacted]", "n": "1"}
    tail = files.log_tail(log, 1).collect()
    assert {(r.file, r.truncated) for r in tail} == {("app.log", True), ("app.log.1", False)}


def test_versioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.current(spark, path) is None
    sinks.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string"), path, ["k"], ["t"])
    sinks.upsert(spark.createDataFrame([(1, 2, "c")], "k int, t int, v string"), path, ["k"], ["t"])
    version = sinks.insert_if_absent(spark.createDataFrame([(1, 9, "no"), (3, 1, "new")], "k int, t int, v string"), path, ["k"])
    assert version == 3
    assert sorted((r.k, r.v) for r in sinks.current(spark, path).collect()) == [(1, "c"), (2, "b"), (3, "new")]


def test_exports(spark, tmp_path):
    reports = spark.createDataFrame([("r1", "m", "2024-01-01"), ("r2", "m", "2024-02-01")], "id string, member_id string, report_issued_at string")
    notes = spark.createDataFrame([("r1", "n1"), ("r1", "n0")], "report_id string, note string")
    docs = {r.report_id: json.loads(r.document) for r in sinks.export_nested(reports, {"notes": notes}).collect()}
    assert docs["r1"]["notes"] == [{"note": "n0"}, {"note": "n1"}] and "notes" not in docs["r2"]
    sinks.append_audit(reports, str(tmp_path / "audit"), F.lit("read"), ["id"])
    sinks.append_audit(reports, str(tmp_path / "audit"), F.lit("read"), ["id"])
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4


def test_declared_tables(spark, tmp_path):
    df = spark.createDataFrame([("m1", "u1")], "member_id string, user_id string")
    assert tables.missing_columns(df, "member_permissions") == ["permission", "granted_by", "granted_at"]
    whole = tables.repaired(df, "member_permissions")
    whole.write.parquet(str(tmp_path / "member_permissions"))
    tables.register(spark, str(tmp_path), ["member_permissions"])
    assert spark.sql("select count(*) from member_permissions").first()[0] == 1
    assert "member_permissions" in tables.known_tables(spark)
    assert {(r.table, r.n) for r in tables.row_counts({"a": df, "b": df.limit(0)}).collect()} == {("a", 1), ("b", 0)}


def test_dictionaries_are_activated_and_rolled_back(spark, tmp_path):
    from quernstone.operators.dictionary import content_hash

    path, columns = str(tmp_path / "dictionary"), ["k", "v"]
    one, two, three = (spark.createDataFrame(d, "k string, v int") for d in ([("a", 1)], [("a", 2), ("b", None)], [("c", 3)]))
    digest = content_hash(two, columns).first().digest
    assert digest == content_hash(two.orderBy("k", ascending=False), columns).first().digest
    assert content_hash(one.union(one), columns).first().digest != content_hash(one, columns).first().digest
    assert sinks.activate(one, path, columns) == 1
    with pytest.raises(ValueError, match="digest"):
        sinks.activate(one, path, columns, expected=digest)
    assert sinks.activate(two, path, columns, expected=digest, base=1) == 2
    assert sinks.activate(two, path, columns) == 2  # the same rows: nothing to do
    with pytest.raises(RuntimeError, match="not 1"):
        sinks.activate(three, path, columns, base=1)
    assert sinks.roll_back(spark, path, 1, base=2) == 3
    assert [tuple(r) for r in sinks.current(spark, path).collect()] == [("a", 1)]
    with pytest.raises(ValueError, match="no version 9"):
        sinks.roll_back(spark, path, 9)


def test_of_two_writers_at_once_one_succeeds(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    sinks.publish(spark.createDataFrame([(0,)], "k int"), path)

    def write(i):
        try:
            return sinks.publish(spark.createDataFrame([(i,)], "k int"), path, base=1), i
        except RuntimeError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [x for x in pool.map(write, range(1, 5)) if x]
    assert len(won) == 1 and won[0][0] == 2
    assert [r.k for r in sinks.current(spark, path).collect()] == [won[0][1]]
    assert sinks.publish(spark.createDataFrame([(9,)], "k int"), path) == 3
