"""Lines with their numbers over several splits; files and tables that are replaced whole or not at all."""

import hashlib

import pytest
from pyspark.sql import functions as F

from panelspark.sources import artifacts, commits


def test_errors_carry_the_line_of_files_of_several_splits(spark, tmp_path):
    want = set()
    for name, n in (("a b.jsonl", 4000), ("c.jsonl", 10), ("empty.jsonl", 0)):
        lines = []
        for i in range(n):
            lines.append(f'{{"a": {i}, "b": "{"x" * (i % 90)}"}}')
            if i % 97 == 5:
                lines.append("")
            if i % 331 == 7:
                lines.append('{"a": ')
                want.add((name, len(lines), "unparsed"))
            if i % 577 == 8:
                lines.append('{"a": 1, "c": 2}')
                want |= {(name, len(lines), "unknown-key"), (name, len(lines), "missing-key")}
        (tmp_path / name).write_bytes("\r\n".join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("7000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert size == before or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
            rows = artifacts.line_errors(spark, str(tmp_path), "a int, b string", ["a", "b"]).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert {(r.path.rsplit("/", 1)[1].replace("%20", " "), r.line, r.code) for r in rows} == want and len(rows) == len(want)
    assert artifacts.line_errors(spark, str(tmp_path / "empty.jsonl"), "a int", ["a"]).count() == 0


def test_files_are_replaced_whole_or_not_at_all(spark, tmp_path):
    f = tmp_path / "x"
    f.write_bytes(b"one")
    digest = hashlib.sha256(b"one").hexdigest()
    assert commits.file_digest(spark, str(f)) == digest
    assert commits.replace_checked(spark, str(f), b"two", digest) == f"{f}.bak" and f.read_bytes() == b"two" and (tmp_path / "x.bak").read_bytes() == b"one"
    with pytest.raises(ValueError, match="changed"):
        commits.replace_checked(spark, str(f), b"three", digest)
    f.write_bytes(b"by hand")  # as another tool would
    assert commits.backup(spark, str(f)).endswith(".bak.1") and (tmp_path / "x.bak.1").read_bytes() == b"by hand"
    commits.put(spark, str(f), b"")
    assert f.read_bytes() == b"" and not list(tmp_path.glob("*.part-*"))
    with pytest.raises(FileExistsError):
        commits.move(spark, str(f), str(tmp_path / "x.bak"))
    with pytest.raises(ValueError, match="overwrite"):
        artifacts.guard_output([str(f)], str(tmp_path / "." / "x"))


def test_tables_are_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "votes")
    df = spark.range(1000).select("id", F.lit(None).cast("string").alias("a.b"))
    digest, kept = commits.publish(df.repartition(3), path)
    assert kept is None and digest == commits.table_digest(spark, path) and spark.read.json(path).count() == 1000
    with pytest.raises(FileExistsError):
        commits.publish(df, path)
    with pytest.raises(ValueError, match="changed"):
        commits.publish(df, path, "0" * 64)
    # a task that fails leaves the old artifact whole
    with pytest.raises(Exception, match="no such row"):
        commits.publish(df.withColumn("x", F.when(F.col("id") == 999, F.raise_error(F.lit("no such row")))), path, digest)
    # a move that fails brings it back
    moved = commits.move

    def failing(spark, source, target, overwrite=False):
        if ".part-" in source:
            raise OSError("lost")
        moved(spark, source, target, overwrite)

    monkeypatch.setattr(commits, "move", failing)
    with pytest.raises(OSError, match="lost"):
        commits.publish(df.limit(1), path, digest)
    monkeypatch.undo()
    assert commits.table_digest(spark, path) == digest and [p.name for p in tmp_path.iterdir()] == ["votes"]
    # the digest tells rows and how often they stand, not their order
    other, kept = commits.publish(df.orderBy(F.desc("id")).coalesce(1), path, digest)
    assert other == digest and kept == f"{path}.bak" and commits.table_digest(spark, kept) == digest
    twice, kept = commits.publish(df.union(df.where("id = 3")), path, digest)
    assert twice != digest and kept == f"{path}.bak.1"
    nothing, _ = commits.publish(df.limit(0), str(tmp_path / "none"))
    assert nothing == commits.table_digest(spark, str(tmp_path / "none"))


def test_reports_are_small(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r.json")
    assert artifacts.write_report(spark.range(2), path) == (tmp_path / "r.json").read_text()
    monkeypatch.setattr(artifacts, "REPORT_ROWS", 5)
    with pytest.raises(ValueError, match="more than 5 rows"):
        artifacts.write_report(spark.range(6), path)
    assert artifacts.write_report(spark.range(5), None).count("id") == 5
