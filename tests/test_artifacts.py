"""Imports of pickles without loading them, findings, refusal and dependencies."""

import collections
import io
import os
import pickle
import random
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.functions import opcodes
from veilmark.operators import artifacts
from veilmark.plans import assess


class Planted:
    def __reduce__(self):
        return os.system, ("true",)


def imports(content):
    return {f"{m}.{n}" for m, n in opcodes.scan_bytes(content)[0]}


VALUE = [collections.OrderedDict(a=1), Planted(), {"b": (1, 2, 3)}, {1, 2}, 2**3000, -7, b"x" * 100_000, "y" * 300_000, 1.5, None, True, ["é", "é"], frozenset("ab"), bytearray(b"z")]
SYSTEM = f"{os.system.__module__}.system"


@pytest.mark.parametrize("protocol", range(pickle.HIGHEST_PROTOCOL + 1))
def test_every_protocol(protocol):
    content = pickle.dumps(VALUE, protocol=protocol)
    found, status = opcodes.scan_bytes(content)
    assert status == "ok" and {SYSTEM, "collections.OrderedDict"} <= imports(content)
    # the same as an unpickler that asks for each class and loads none
    asked = set()

    class Asking(pickle.Unpickler):
        def find_class(self, module, name):
            asked.add((module, name))
            return {"system": lambda *_: None}.get(name) or super().find_class(module, name)

    Asking(io.BytesIO(content), fix_imports=False).load() if protocol > 2 else None
    assert protocol <= 2 or found == asked


def test_every_cut_is_truncated_and_keeps_earlier_imports():
    content = pickle.dumps([Planted(), "tail"], protocol=4)
    at = content.index(b"\x93") + 1
    for cut in range(1, len(content)):
        found, status = opcodes.scan_bytes(content[:cut])
        assert status == "truncated" and bool(found) == (cut >= at)
    noise = random.Random(1)
    for _ in range(2000):
        broken = bytearray(content)
        broken[noise.randrange(len(broken))] = noise.randrange(256)
        assert opcodes.scan_bytes(bytes(broken))[1] in {"ok", "truncated", "malformed", "trailing"}


def test_hidden_imports():
    assert imports(b"\x80\x04\x8c\x02os\x94\x8c\x06system\x94h\x00h\x01\x93.") == {"os.system"}  # both from the memo
    assert imports(b"\x80\x04\x8c\x01x0\x8c\x02os2\x30\x8c\x06system\x93.") == {"os.system"}  # behind dropped texts
    assert imports(b"(S'true'\nios\nsystem\n.") == {"os.system"}
    assert imports(b"S'o\\x73'\nVsystem\n\x93.") == {"os.system"}
    assert imports(b"\x80\x04N\x8c\x06system\x93.") == {"?.system"}
    assert imports(b"\x80\x02\x82\x05.") == {"?.extension 5"}
    assert imports(pickle.dumps(1) + pickle.dumps(Planted())) == {SYSTEM}
    assert opcodes.scan_bytes(pickle.dumps(1) + b"\xff\xff")[1] == "trailing"
    assert opcodes.scan_bytes(b"\x93.") == (set(), "malformed") and opcodes.scan_bytes(b"h\x05.")[1] == "malformed" and opcodes.scan_bytes(b"") == (set(), "empty")


def test_containers():
    objects, numbers, archive = io.BytesIO(), io.BytesIO(), io.BytesIO()
    np.save(objects, np.array([Planted(), 1], dtype=object), allow_pickle=True)
    np.save(numbers, np.arange(5))
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("m/data.pkl", pickle.dumps(Planted()))
        z.writestr("m/data/0", b"\x00" * 1000)
    assert SYSTEM in imports(objects.getvalue()) and opcodes.scan_bytes(numbers.getvalue()) == (set(), "data")
    assert imports(archive.getvalue()) == {SYSTEM} and opcodes.scan_bytes(archive.getvalue()[:-30])[1] == "malformed"
    assert opcodes.scan_bytes(objects.getvalue()[:40])[1] == opcodes.scan_bytes(b"\x93NUMPY")[1] == "truncated"


def test_long_arguments_are_skipped():
    class Counting(io.BytesIO):
        most = 0

        def read(self, n=-1):
            out = super().read(n)
            self.most = max(self.most, len(out))
            return out

    stream = Counting(pickle.dumps([b"x" * 9_000_000, Planted()], protocol=5))
    stream.peek = lambda n: stream.getvalue()[:n]
    assert {n for _, n in opcodes.scan(stream)[0]} == {"system"} and stream.most <= opcodes.BLOCK


def test_findings(spark):
    rows = [("a.pkl", pickle.dumps(Planted())), ("b.joblib", pickle.dumps({"x": 1})), ("c.safetensors", b"??"), ("d", b"??"), ("e.pt", None), ("f.pkl", pickle.dumps(Planted())[:-1]), ("g.pkl", pickle.dumps(Planted)), (None, pickle.dumps(1)), ("b.joblib", pickle.dumps({"x": 1}))]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("status", F.lit("clash"))
    scanned = artifacts.scan_content(df, "path").cache()
    got = sorted((r.location or "", r.category, r.severity, r["count"], ",".join(r.details)) for r in artifacts.findings(scanned, "path").collect())
    module = Planted.__module__.split(".")[0]
    assert got == [
        ("", "UNKNOWN_FORMAT", "low", 1, ""), ("a.pkl", "RAW_PICKLE_FORMAT", "low", 1, ""), ("a.pkl", "UNSAFE_PICKLE", "critical", 1, SYSTEM), ("b.joblib", "RAW_PICKLE_FORMAT", "low", 0, ""), ("b.joblib", "RAW_PICKLE_FORMAT", "low", 0, ""),
        ("c.safetensors", "SAFE_FORMAT", "info", 1, ""), ("d", "UNKNOWN_FORMAT", "low", 1, ""), ("e.pt", "SCAN_ERROR", "high", 1, "empty"), ("f.pkl", "SCAN_ERROR", "high", 1, "truncated"), ("f.pkl", "UNSAFE_PICKLE", "critical", 1, SYSTEM), ("g.pkl", "RAW_PICKLE_FORMAT", "low", 1, module),
    ]
    assert sorted(r.path or "" for r in artifacts.refuse_unsafe(scanned).collect()) == ["", "b.joblib", "b.joblib", "g.pkl"]
    assert artifacts.findings(artifacts.scan_content(df.limit(0), "path"), "path").count() == 0
    safe = spark.createDataFrame([("os", "path.join"), ("os.path", "join"), ("x", "y.os.system"), ("builtins", "set"), ("builtins", "getattr"), ("ossify", "run")], "m string, n string")
    assert [r.s for r in safe.select(artifacts.safety(F.col("m"), F.col("n")).alias("s")).collect()] == ["dangerous", "dangerous", "dangerous", "safe", "dangerous", "suspicious"]


def test_files_are_streamed(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "model one.PKL").write_bytes(pickle.dumps(Planted()))
    (tmp_path / "w.safetensors").write_bytes(b"\x00" * 10)
    (tmp_path / "vocab.txt").write_bytes(pickle.dumps(Planted()))
    (tmp_path / "cut.bin").write_bytes(pickle.dumps(Planted())[:-1])
    got = {r.path.rsplit("/", 1)[-1]: (len(r.imports), r.status) for r in artifacts.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"model one.PKL": (1, "ok"), "w.safetensors": (0, "data"), "cut.bin": (1, "truncated")}


def test_assessment(spark):
    df = spark.createDataFrame([("good.pkl", pickle.dumps({"w": 1})), ("bad.pkl", pickle.dumps(Planted()))], "path string, content binary")
    scanned = artifacts.scan_content(df, "path").cache()
    pins = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("Own", "1")], "name string, version string")
    advisories = spark.createDataFrame([("a", "1", "PYSEC-1", ["GHSA-x", "CVE-9"], ["2"], 1), ("b", "2", "PYSEC-1", None, [], 0), ("a", "1", "GHSA-y", None, None, 2), ("a", "3", "GHSA-z", None, None, 3), ("Own", "1", "GHSA-w", [], [], 4)], "name string, version string, id string, aliases array<string>, fix_versions array<string>, position int")
    severities = spark.createDataFrame([("GHSA-y", "low"), ("GHSA-y", "high"), ("GHSA-x", "critical")], "id string, severity string")
    got = sorted((r.category, r.severity, r.location) for r in artifacts.dependency_findings(pins, advisories, severities, ("own",)).collect())
    assert got == [("GHSA-y", "high", "a==1"), ("PYSEC-1", "medium", "b==2")]
    losses = spark.createDataFrame([(float(i),) for i in range(50)], "loss double")
    members = losses.select((F.col("loss") / 10).alias("loss"))
    found, attack = assess.assess_models(scanned, "path", "good.pkl", pins, advisories, severities, members, losses)
    assert attack.count() == 1 and found.where("category = 'AUDIT_SKIPPED'").count() == 0
    for model in ("bad.pkl", "missing.pkl"):
        found, attack = assess.assess_models(scanned, "path", model, pins, advisories, severities, members, losses)
        assert attack is None and [r.location for r in found.where("category = 'AUDIT_SKIPPED'").collect()] == [model]


def test_no_module_is_loaded():
    opcodes.scan_bytes(b"cantigravity\nfly\n.")
    assert "antigravity" not in sys.modules


def test_advisory_without_cve_goes_first_among_ties(spark):
    """One package, version and position: the order of the SQL is no CVE name, then the name, then the fix."""
    rows = [("V-1", "a", "1", 1, ["CVE-9", "GHSA-1"], ["2.1"]), ("V-1", "a", "1", 1, ["GHSA-1"], ["2.7"]), ("V-1", "a", "1", 1, ["GHSA-1"], ["2.5"]), ("V-2", "a", "1", None, ["GHSA-2"], ["2.1"]), ("V-2", "a", "1", 4, ["CVE-2", "GHSA-2"], ["2.3"])]
    advisories = spark.createDataFrame(rows, "id string, name string, version string, position int, aliases array<string>, fix_versions array<string>")
    pins = spark.createDataFrame([("a", "1")], "name string, version string")
    got = artifacts.dependency_findings(pins, advisories, spark.createDataFrame([], "id string, severity string")).select("category", "details.id", "details.fix_versions").collect()
    assert sorted(map(tuple, got)) == [("CVE-2", "V-2", ["2.3"]), ("V-1", "V-1", ["2.5"])]
