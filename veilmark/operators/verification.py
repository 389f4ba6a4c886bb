"""Integrity of signed documents, a JSON text in a row each: Merkle root, key, signature and event chain.

A document is an object with ``identity`` (its Merkle root, key fingerprint and signature), ``artifacts`` (each with a ``sha256``) and
``events``.  The signature covers the canonical text of the document without its events and with an empty signature; each event is signed
alike and names the hash of the event before it, the first that of the signed text.

Canonical texts come from VARIANT, whose objects are sorted: everything stays a Column expression, events are compared with their
neighbours inside the row, and no document is shuffled.  VARIANT reads ``1.0`` as ``1``, so documents with such numbers
(also exponents, negative zero, characters beyond 16 bits or repeated keys) take a per-row helper with the same results.

Defined results: a null or unreadable text, or one that is no object, is unparsed and fails everything; a document without
artifacts, or with a hash that is not 64 hex digits, has no root and fails it; an event that is no object is malformed and hashed as it stands;
repeated documents each give a row.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ed25519
from ..functions.documents import canonical_json, signing_payload

_EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "prev", "signature", "body", "whole")])
_PARTS = T.StructType([T.StructField("payload", T.StringType()), T.StructField("events", T.ArrayType(_EVENT))])

_STRINGS = r'"(?:[^"\\]++|\\.)*+"'
#: outside strings: numbers that VARIANT writes otherwise; anywhere: characters that sort otherwise there
_OWN_NUMBERS, _WIDE = r"[0-9][.eE]|-0(?![0-9])|[0-9]{39}", r"[\x{10000}-\x{10FFFF}]|\\u[dD][89abAB]"


# --- canonical text -------------------------------------------------------------------------------
def variant(document: Column) -> Column:
    """The document as VARIANT; null unless the whole text is one JSON value."""
    # in brackets, so that a text with something behind its value is no JSON
    several = F.try_parse_json(F.concat(F.lit("["), document, F.lit("]"))).try_cast("array<variant>")
    return _once(several, lambda some: F.when(F.size(some) == 1, F.get(some, F.lit(0))))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lower_escapes(text: Column) -> Column:
    """Control characters as \\u001f, not \\u001F."""

    def lowered(t: Column) -> Column:
        out = t
        for digit in "0B 0E 0F 1A 1B 1C 1D 1E 1F".split():
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{digit}", rf"$1\\u00{digit.lower()}")
        return F.when(t.contains(r"\u00"), out).otherwise(t)

    return _once(text, lowered)


def canonical(value: Column) -> Column:
    """JSON text of a VARIANT: sorted keys, no spaces."""
    return _lower_escapes(F.to_json(value))


def _without_signature(entries: Column) -> Column:
    """The VARIANT of an object's entries with its signature emptied."""
    kept = F.map_filter(entries, lambda k, _: k != "signature")
    return F.parse_json(F.to_json(F.map_concat(kept, F.create_map(F.lit("signature"), F.parse_json(F.lit("null"))))))


def _native_parts(v: Column) -> Column:
    top = v.try_cast("map<string,variant>")
    identity = F.try_variant_get(v, "$.identity", "map<string,variant>")
    signed = F.transform_values(F.map_filter(top, lambda k, _: k != "events"), lambda k, x: F.when((k == "identity") & identity.isNotNull(), _without_signature(identity)).otherwise(x))
    text = lambda e, name: F.try_variant_get(e, f"$.{name}", "string")

    def event(e: Column) -> Column:
        entries = e.try_cast("map<string,variant>")
        body = F.when(entries.isNotNull(), canonical(_without_signature(entries)))
        return F.struct(text(e, "event_type").alias("kind"), text(e, "prev_event_sha256").alias("prev"), text(e, "signature").alias("signature"), body.alias("body"), canonical(e).alias("whole"))

    events = F.coalesce(F.transform(F.try_variant_get(v, "$.events", "array<variant>"), event), F.array().cast(f"array<{_EVENT.simpleString()}>"))
    return F.when(top.isNotNull(), F.struct(canonical(F.parse_json(F.to_json(signed))).alias("payload"), events.alias("events")))


def parts_of(document: str | None) -> dict | None:
    """payload and events of a document's text, or None where it is no JSON object; what the Column form gives for plain documents."""
    try:
        data = json.loads(document)
        if not isinstance(data, dict):
            return None
        shown = lambda e, k: e.get(k) if isinstance(e, dict) and isinstance(e.get(k), str) else None
        events = data.get("events") if isinstance(data.get("events"), list) else []
        out = []
        for e in events:
            body = canonical_json(e | {"signature": None}).decode() if isinstance(e, dict) else None
            out.append({"kind": shown(e, "event_type"), "prev": shown(e, "prev_event_sha256"), "signature": shown(e, "signature"), "body": body, "whole": canonical_json(e).decode()})
        return {"payload": signing_payload(data).decode(), "events": out}
    except (TypeError, ValueError):
        return None


def _opaque(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """A pandas function that Catalyst computes once: others are copied to where they are used, even into lambdas, where they can't run."""
    return F.pandas_udf(f, kind).asNondeterministic()


def _helper_parts(document: Column) -> Column:
    def run(document: pd.Series) -> pd.DataFrame:
        found = document.map(parts_of)
        return pd.DataFrame({"payload": [p and p["payload"] for p in found], "events": [p and p["events"] for p in found]}, dtype=object)

    run.__annotations__ = {"document": pd.Series, "return": pd.DataFrame}
    return _opaque(run, _PARTS)(document)


def with_parts(docs: DataFrame, document: str = "document", name: str = "parts") -> DataFrame:
    """docs with a struct(payload, events): the signed text, and for each event its kind, prev, signature, body (what is signed) and whole (what is hashed)."""
    plain = lambda d: ~F.regexp_replace(d, _STRINGS, "").rlike(_OWN_NUMBERS) & ~d.rlike(_WIDE)
    d, helped = F.col(document), F.col("__helped")
    # the document is parsed once, for its parts and for what goes to the helper
    rows = docs.withColumn("__native", F.when(plain(d), _once(variant(d), lambda v: F.struct(v.isNotNull().alias("read"), _native_parts(v).alias("parts")))))
    rest = F.when(~F.coalesce(F.col("__native.read"), F.lit(False)), d)
    rows = rows.withColumn("__helped", _helper_parts(rest))
    return rows.withColumn(name, F.coalesce(F.col("__native.parts"), F.when(helped["payload"].isNotNull(), helped))).drop("__helped", "__native")


# --- checks ---------------------------------------------------------------------------------------
def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def merkle_root(hashes: Column) -> Column:
    """Root over the sorted hex hashes of a row's array, as ``provenance.merkle_levels`` over a table; null without
    hashes or with a malformed one."""
    leaf = F.transform(F.array_sort(hashes), lambda h: F.sha2(F.concat(F.lit(b"\x00"), F.unhex(h)), 256))

    def up(level: Column, _: Column) -> Column:
        node = lambda i: F.sha2(F.concat(F.lit(b"\x01"), F.unhex(F.get(level, 2 * i)), F.unhex(F.get(level, 2 * i + 1))), 256)
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: F.coalesce(node(i), F.get(level, 2 * i)))
        return F.when(F.size(level) > 1, pairs).otherwise(level)

    well = (F.size(hashes) > 0) & F.forall(hashes, lambda h: F.coalesce(h.rlike("^[0-9a-f]{64}$"), F.lit(False)))
    levels = F.sequence(F.lit(1), F.ceil(F.log2(F.size(hashes).cast("double"))).cast("int") + 1)
    return F.when(well, F.get(F.aggregate(levels, leaf, up), F.lit(0)))


def key_fingerprint(key: bytes) -> str:
    return f"sha256:{hashlib.sha256(key).hexdigest()}"


def signatures_hold(key: bytes) -> Callable[[Column], Column]:
    """Of an array of struct(text, signature in base64), which signatures are of their text; null or malformed ones are not."""

    def holds(text: str | None, signature: str | None) -> bool:
        try:
            return text is not None and ed25519.verify(key, text.encode(), base64.b64decode(signature, validate=True))
        except (TypeError, ValueError):
            return False

    def run(pairs: pd.Series) -> pd.Series:
        return pairs.map(lambda some: None if some is None else [holds(p["text"], p["signature"]) for p in some])

    run.__annotations__ = {"pairs": pd.Series, "return": pd.Series}
    return _opaque(run, T.ArrayType(T.BooleanType()))


def previous_hash(p: Column) -> Column:
    """What the next event of a document must name: the hash of its last event, or of the signed text."""
    last = F.element_at(p["events"], -1)["whole"]
    return F.when(F.size(p["events"]) > 0, sha256(last)).otherwise(sha256(p["payload"]))


def verify_documents(docs: DataFrame, key: bytes, document: str = "document") -> DataFrame:
    """docs with parsed, payload_sha256, merkle_ok, fingerprint_ok, signature_ok, event_problems and verified in place of the document.

    event_problems: (event, problem) with problem ``chain`` (it does not name the event before it), ``signature`` or ``malformed``.
    """
    return _checked(with_parts(docs, document, "__p"), key, document, [c for c in docs.columns if c != document])


def _checked(rows: DataFrame, key: bytes, document: str, kept: list[str]) -> DataFrame:
    """verify_documents() of rows whose parts are in __p."""
    rows = rows.withColumn("__v", variant(F.col(document)))
    read = lambda path, kind="string": F.try_variant_get(F.coalesce("__v", F.try_parse_json(F.col(document))), path, kind)
    hashes = F.transform(read("$.artifacts", "array<variant>"), lambda a: F.try_variant_get(a, "$.sha256", "string"))
    events = F.col("__p.events")
    pair = lambda text, signature: F.struct(text.alias("text"), signature.alias("signature"))
    signed = F.concat(F.array(pair(F.col("__p.payload"), read("$.identity.signature"))), F.transform(events, lambda e: pair(e["body"], e["signature"])))
    rows = rows.withColumns({"__good": signatures_hold(key)(F.when(F.col("__p").isNotNull(), signed)), "__anchor": sha256(F.col("__p.payload")), "__root": _once(hashes, merkle_root)})

    def problems(x: Column) -> Column:
        def of(e: Column, i: Column) -> Column:
            before = F.when(i == 0, x["anchor"]).otherwise(sha256(F.get(x["events"], i - 1)["whole"]))
            named = lambda bad, problem: F.when(bad, F.struct(i.alias("event"), F.lit(problem).alias("problem")))
            found = F.array(named(e["body"].isNull(), "malformed"), named(~F.coalesce(e["prev"] == before, F.lit(False)), "chain"), named(~F.get(x["good"], i + 1), "signature"))
            return F.array_compact(found)

        return F.flatten(F.transform(x["events"], of))

    seen = F.struct(events.alias("events"), F.col("__good").alias("good"), F.col("__anchor").alias("anchor"))

    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns({
        "parsed": F.col("__p").isNotNull(),
        "payload_sha256": F.col("__anchor"),
        "merkle_ok": yes(F.col("__root") == read("$.identity.merkle_root")),
        "fingerprint_ok": yes(read("$.identity.public_key_fingerprint") == key_fingerprint(key)),
        "signature_ok": yes(F.get("__good", F.lit(0))),
        "event_problems": _once(seen, problems),
    })
    checks = ["parsed", "payload_sha256", "merkle_ok", "fingerprint_ok", "signature_ok", "event_problems"]
    return rows.select(*kept, *checks, (F.col("merkle_ok") & F.col("fingerprint_ok") & F.col("signature_ok") & yes(F.size("event_problems") == 0)).alias("verified"))


def sealed(seed: bytes) -> Callable[[Column, Column], Column]:
    """Column function (document, array of events): the document with its signature and the events chained and signed after it.

    Both are JSON texts; an event's own prev and signature are replaced.  Null where the document is no object with an identity.
    """
    encode = lambda data: base64.b64encode(ed25519.sign(seed, data)).decode()

    def one(document: str | None, events: list[str] | None) -> str | None:
        try:
            data = json.loads(document)
            data["identity"]["signature"] = encode(signing_payload(data))
            before, chain = hashlib.sha256(signing_payload(data)).hexdigest(), list(data.get("events") or [])
            if chain:
                before = hashlib.sha256(canonical_json(chain[-1])).hexdigest()
            for text in [] if events is None else events:
                event = json.loads(text) | {"prev_event_sha256": before, "signature": None}
                event["signature"] = encode(canonical_json(event))
                before = hashlib.sha256(canonical_json(event)).hexdigest()
                chain.append(event)
            return canonical_json(data | {"events": chain}).decode()
        except (KeyError, TypeError, ValueError):
            return None

    def run(document: pd.Series, events: pd.Series) -> pd.Series:
        return pd.Series([one(d, e) for d, e in zip(document, events, strict=True)], dtype=object)

    run.__annotations__ = {"document": pd.Series, "events": pd.Series, "return": pd.Series}
    return _opaque(run, T.StringType())


def accept_events(stored: DataFrame, offered: DataFrame, key: bytes) -> DataFrame:
    """offered(id, event) with accepted and reason: an event is taken if its document stored(id, document) is verified, the event names the
    hash that comes next and its signature holds.

    Reasons are ``unknown``, ``invalid``, ``chain`` and ``signature``; of several events for one document only those that name that hash fit.
    """
    docs = with_parts(stored, "document", "__p").withColumn("__next", previous_hash(F.col("__p")))
    docs = _checked(docs, key, "document", ["id", "__next"]).select("id", "verified", "__next")
    wrapped = offered.withColumn("__d", F.concat(F.lit('{"events":['), F.col("event"), F.lit("]}")))
    rows = with_parts(wrapped, "__d", "__q").withColumn("__e", F.get(F.col("__q.events"), F.lit(0))).drop("__d", "__q")
    rows = rows.withColumn("__good", signatures_hold(key)(F.array(F.struct(F.col("__e.body").alias("text"), F.col("__e.signature").alias("signature"))))).join(docs, "id", "left")
    reason = F.when(F.col("verified").isNull(), "unknown").when(~F.col("verified"), "invalid").when(~F.coalesce(F.col("__e.prev") == F.col("__next"), F.lit(False)), "chain").when(~F.get("__good", F.lit(0)), "signature")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).select(*offered.columns, "accepted", "reason")
