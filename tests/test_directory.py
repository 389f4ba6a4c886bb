"""Signed documents in a folder: broken files, working copy over archive, pushed filters."""

import json

from pyspark.sql import functions as F

from veilmark.sources.directory import read_directory, working_copies


def doc(i, version="1", verdict=None, model="m", **more):
    policy = {"policy": {"verdict": verdict}} if verdict else {}
    return json.dumps({"identity": {"passport_id": i, "model_name": model, "version": version, "created_at": f"2024-01-0{version}"}, **policy, **more})


def folder(tmp_path):
    (tmp_path / "history").mkdir()
    files = {"a.json": doc("a", "2", "pass"), "b.json": doc("b", "1", "fail", "n"), "history/a1.json": doc("a", "1", "fail", revision={"sequence": 1}), "history/c.json": doc("c", "3", "fail"), "history/c2.json": doc("c", "4")}
    broken = {"x.json": "{", "y.json": "[1]", "z.json": '{"identity": {"passport_id": 5}}', "e.json": "", "n.json": doc("q", revision={"sequence": "one"}), "t.txt": doc("t"), "_s.json": doc("s")}
    for name, text in (files | broken).items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bytes.json").write_bytes(b"\xff\xfe{")
    return str(tmp_path)


def test_rows(spark, tmp_path):
    where = folder(tmp_path)
    got = {(r.passport_id, r.version, r.verdict, r.sequence, r.archived) for r in read_directory(spark, where, files_per_task="1").collect()}
    assert got == {("a", "2", "pass", None, False), ("b", "1", "fail", None, False), ("a", "1", "fail", 1, True), ("c", "3", "fail", None, True), ("c", "4", None, None, True)}
    assert read_directory(spark, f"file://{where}").count() == 5 and read_directory(spark, f"{where}/nowhere").count() == 0
    best = {(r.passport_id, r.version) for r in working_copies(read_directory(spark, where)).collect()}
    assert best == {("a", "2"), ("b", "1"), ("c", "3")}
    failed = {r.passport_id for r in working_copies(read_directory(spark, where)).where("verdict = 'fail'").collect()}
    assert failed == {"b", "c"}  # not the archived copy of a


def test_pushed_filters(spark, tmp_path, capsys):
    df = read_directory(spark, folder(tmp_path))
    some = df.where((F.col("verdict") == "fail") & (F.col("archived") == F.lit(True)) & F.col("path").contains("c"))
    some.explain()
    plan = capsys.readouterr().out
    kept = plan.split("Filter", 1)[1].split("\n", 1)[0]
    assert "contains(path" in kept.lower() and "verdict" not in kept.replace("isnotnull(verdict", "") and [r.passport_id for r in some.collect()] == ["c"]
    assert working_copies(df).where("passport_id = 'a'").count() == 1 and df.where("verdict = 'fail' and verdict = 'pass'").count() == 0


def test_lines(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text("\n".join([doc("a"), "oops", doc("b")]) + "\n")
    assert read_directory(spark, str(tmp_path), lines="true", suffix=".txt").count() == 2
