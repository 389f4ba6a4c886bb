"""Signed documents: RFC 8032 vectors, canonical texts by two ways, and every kind of tampering."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veilmark.functions import ed25519
from veilmark.functions.documents import canonical_json
from veilmark.operators import verification as V

SEED = hashlib.sha256(b"test key").digest()
KEY = ed25519.public_key(SEED)


@pytest.mark.parametrize(("seed", "public", "message", "signature"), [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
])
def test_rfc_vectors(seed, public, message, signature):
    seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
    assert ed25519.public_key(seed) == public and ed25519.sign(seed, message) == signature
    assert ed25519.verify(public, message, signature)
    assert not ed25519.verify(public, message + b"!", signature) and not ed25519.verify(public, message, signature[:-1] + b"\x7f")
    assert not ed25519.verify(public[:-1], message, signature) and not ed25519.verify(public, message, b"")


TEXTS = [
    '{"b": 1, "a": {"z": [1, -3, null, true], "y": "1.5e3"}, "events": [{"k": "v", "signature": "s"}, 7]}',
    '{"identity": {"signature": "abc", "z": 1}, "a": "q\\u001f\\u001e\\n\\"\\\\u001F \\/ \\u00e9  "}',
    '{"identity": {"a": 1}, "events": []}',
    '{"identity": 5, "events": {"no": "list"}}',
    '{"x": 1.0, "y": [1e5, -0.0, 2.50], "events": [{"event_type": "t", "payload": {"score": 0.10}}]}',
    '{"a": 1, "a": 2}', '{"\U0001f600": 1, "￮": 2}', '{"a": "\\ud83d\\ude00"}', '{"n": 123456789012345678901234567890123456789012}', '{"a": -0}', "{}",
    "[1]", "7", '{"a": 1} x', "nope", '{"a": NaN}', "", " ", None,
]


def test_parts(spark):
    """The Column form and the per-row helper agree, and most plain texts take the Column form."""
    df = spark.createDataFrame([(i, d) for i, d in enumerate(TEXTS)], "i int, d string")
    got = {r.i: r.p.asDict(True) if r.p else None for r in V.with_parts(df, "d", "p").collect()}
    assert got == {i: V.parts_of(d) for i, d in enumerate(TEXTS)}
    native = {r.i: r.p.asDict(True) for r in df.select("i", V._native_parts(V.variant(F.col("d"))).alias("p")).where("p is not null").collect()}
    assert {0, 1, 2, 3, 10} <= native.keys() and all(native[i] == got[i] for i in (0, 1, 2, 3, 10))


def root(hashes):
    level = [hashlib.sha256(b"\0" + bytes.fromhex(h)).digest() for h in sorted(hashes)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def test_merkle_root(spark):
    every = [hashlib.sha256(bytes([i])).hexdigest() for i in range(9)]
    rows = [(n, every[:n]) for n in range(10)] + [(20, ["zz"]), (21, [None]), (22, None), (23, [every[0], every[0]])]
    got = {r.n: r.root for r in spark.createDataFrame(rows, "n int, h array<string>").select("n", V.merkle_root(F.col("h")).alias("root")).collect()}
    assert all(got[n] == root(every[:n]) for n in range(1, 10)) and got[0] is got[20] is got[21] is got[22] is None and got[23] == root([every[0]] * 2)


def document(hashes=("00" * 32, "11" * 32, "22" * 32), **more):
    return {"identity": {"passport_id": "p", "merkle_root": root(hashes), "public_key_fingerprint": V.key_fingerprint(KEY), "signature": None}, "artifacts": [{"path": f"f{i}", "sha256": h} for i, h in enumerate(hashes)], **more}


@pytest.fixture(scope="module")
def signed(spark):
    events = [json.dumps({"event_type": f"e{i}", "payload": {"n": i}}) for i in range(3)]
    df = spark.createDataFrame([(json.dumps(document(version="1.0")), events), (json.dumps(document(score=0.50)), events)], "d string, e array<string>")
    return [json.loads(r[0]) for r in df.select(V.sealed(SEED)("d", "e")).collect()]


def test_tampering(spark, signed):
    def changed(edit, at=0):
        copy = json.loads(json.dumps(signed[at]))
        edit(copy)
        return json.dumps(copy, indent=1)

    rows = {
        "whole": changed(lambda d: None),
        "floats": changed(lambda d: None, 1),
        "artifact": changed(lambda d: d["artifacts"][1].update(sha256="33" * 32)),
        "field": changed(lambda d: d.update(extra=1)),
        "float": changed(lambda d: d.update(score=0.51), 1),
        "removed": changed(lambda d: d["events"].pop(1)),
        "swapped": changed(lambda d: d["events"].insert(0, d["events"].pop(1))),
        "edited": changed(lambda d: d["events"][0]["payload"].update(n=9)),
        "no signature": changed(lambda d: d["identity"].update(signature="!!")),
        "odd event": changed(lambda d: d["events"].append("x")),
        "other key": changed(lambda d: d["identity"].update(public_key_fingerprint="sha256:00")),
        "cut": changed(lambda d: None)[:-3],
        "null": None,
        "no artifacts": json.dumps(document() | {"artifacts": []}),
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in rows.items()], "name string, document string, parsed int").drop("parsed")
    got = {r.name: r for r in V.verify_documents(df, KEY).collect()}
    flags = {k: (r.parsed, r.merkle_ok, r.fingerprint_ok, r.signature_ok, r.verified) for k, r in got.items()}
    good = (True,) * 5
    assert flags["whole"] == flags["floats"] == good
    assert flags["artifact"] == (True, False, True, False, False) and flags["field"] == flags["float"] == (True, True, True, False, False)
    assert flags["removed"] == flags["swapped"] == flags["edited"] == flags["odd event"] == (True, True, True, True, False)
    assert flags["no signature"] == (True, True, True, False, False) and flags["other key"] == (True, True, False, False, False)
    assert flags["cut"] == flags["null"] == (False,) * 5 and not flags["no artifacts"][1]
    shown = lambda k: [(p.event, p.problem) for p in got[k].event_problems]
    assert shown("removed") == [(1, "chain")] and shown("edited") == [(0, "signature"), (1, "chain")] and shown("swapped") == [(0, "chain"), (1, "chain"), (2, "chain")]
    assert shown("artifact") == shown("field") == [(0, "chain")] and shown("odd event") == [(3, "malformed"), (3, "chain"), (3, "signature")] and shown("no signature") == []


def test_accept_events(spark, signed):
    base = signed[0]
    last = hashlib.sha256(canonical_json(base["events"][-1])).hexdigest()

    def event(prev, seed=SEED):
        body = {"event_type": "next", "prev_event_sha256": prev, "signature": None}
        return json.dumps(body | {"signature": base64.b64encode(ed25519.sign(seed, canonical_json(body))).decode()})

    broken = json.loads(json.dumps(base))
    broken["events"].pop(0)
    stored = spark.createDataFrame([("a", json.dumps(base)), ("b", json.dumps(broken))], "id string, document string")
    offers = [("a", event(last), 1), ("a", event("00" * 32), 2), ("a", event(last, b"x" * 32), 3), ("b", event(last), 4), ("c", event(last), 5), ("a", "no json", 6), ("a", None, 7)]
    got = {r.n: r.reason for r in V.accept_events(stored, spark.createDataFrame(offers, "id string, event string, n int"), KEY).collect()}
    assert got == {1: None, 2: "chain", 3: "signature", 4: "invalid", 5: "unknown", 6: "chain", 7: "chain"}


def test_products_of_known_points_come_from_tables():
    """A key's and the base point's multiples are made once: a signature takes some 130 additions instead of 1,500."""
    from veilmark.functions import ed25519

    seed, calls, add = bytes(range(32)), [0], ed25519._add
    key = ed25519.public_key(seed)
    assert ed25519.verify(key, b"first", ed25519.sign(seed, b"first"))

    def counted(a, b):
        calls[0] += 1
        return add(a, b)

    ed25519._add = counted
    try:
        signature = ed25519.sign(seed, b"text")
        assert ed25519.verify(key, b"text", signature) and not ed25519.verify(key, b"other", signature)
    finally:
        ed25519._add = add
    assert calls[0] < 400
