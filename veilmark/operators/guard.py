"""The guard between people and a model: requests lose their personal values, replies are reviewed and get them back.

A request's values become placeholders such as ``[EMAIL_1]``, one for each different value of a conversation, numbered within its type by where it first
stands.  In replies a value that no earlier request named is a leak; placeholders of earlier requests are turned back.

Texts are edited by what is joined to them value by value: a row's key is the hash of all that its edits depend on, so rows without a conversation or a
turn, and different rows of one turn, never take each other's edits; equal rows get equal ones.  No conversation is gathered in one place.

Defined results: a null text is empty; a row without conv_id is a conversation of its own; a null turn is before all others, and what stands there is
known to later turns only; a role that is not ``assistant`` is a request; values of a blocked text get no placeholder.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from . import detectors as D
from .text import fingerprint

PLACEHOLDER = r"\[[A-Z][A-Z0-9]*_[0-9]+\]"  # fixed value
_FIRST = -(1 << 63)


@dataclass(frozen=True)
class GuardPolicy:
    """What happens to a found value: mask (numbered placeholder, restored in replies), redact, block (the text) or allow."""

    inbound: dict[str, str] = field(default_factory=dict)
    inbound_default: str = "mask"
    outbound: dict[str, str] = field(default_factory=dict)
    memorized: str = "redact"

    def request_actions(self) -> dict[str, str]:
        return {"DATE": "allow"} | self.inbound

    def reply_actions(self) -> dict[str, str]:
        return {kind: "redact" for kind, weight in P.IMPACT.items() if weight == 1.0} | self.outbound


def _action(kind: Column, actions: dict[str, str], otherwise: str) -> Column:
    """The action of a type by a table of types."""
    table = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair]) if actions else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, kind), F.lit(otherwise))


def restore(text: str, placeholders: dict[str, str], json_safe: bool = False) -> str:
    """The text with the values of its placeholders; unknown ones stay, and values are escaped for JSON if asked."""
    return re.sub(PLACEHOLDER, lambda m: (json.dumps(placeholders[m[0]])[1:-1] if json_safe else placeholders[m[0]]) if m[0] in placeholders else m[0], text)


def keyed(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with conversation, at (the turn, nulls first), request, text never null, and row_key."""
    turns = turns.withColumn("text", F.coalesce("text", F.lit("")))
    # fields of null are left out of the JSON, so no null looks like a value
    key = F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")).cast("binary"), 256)
    turns = turns.withColumns({"row_key": key, "at": F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)), "request": ~F.coalesce(F.col("role") == "assistant", F.lit(False))})
    own = F.concat(F.lit("row:"), F.col("row_key"))
    return turns.withColumn("conversation", F.coalesce(F.concat(F.lit("id:"), F.col("conv_id").cast("string")), own))


def found_values(rows: DataFrame, detectors: Sequence[D.Detector | str] = ("patterns",)) -> DataFrame:
    """row_key, conversation, at, request, start, end, entity_type, value: each span of each different row."""
    spans = rows.select("row_key", "conversation", "at", "request", "text", D.spans(F.col("text"), detectors).alias("spans"))
    spans = spans.select("row_key", "conversation", "at", "request", "text", F.explode("spans").alias("s"))
    return spans.select("row_key", "conversation", "at", "request", "s.*", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value")).distinct()


def placeholders(asked: DataFrame) -> DataFrame:
    """conversation, entity_type, value, since, token of asked(conversation, at, start, entity_type, value)."""
    first = asked.groupBy("conversation", "entity_type", "value").agg(F.min(F.struct("at", "start")).alias("first"))
    number = F.row_number().over(Window.partitionBy("conversation", "entity_type").orderBy("first", "value"))
    return first.select("conversation", "entity_type", "value", F.col("first.at").alias("since"), F.concat(F.lit("["), "entity_type", F.lit("_"), number.cast("string"), F.lit("]")).alias("token"))


def edited(text: Column, edits: Column) -> Column:
    """The text with each of its sorted edits (start, end, shown) put in."""
    upto = lambda i: F.coalesce(F.get(edits, i - 1)["end"], F.lit(0))
    parts = F.transform(edits, lambda e, i: F.concat(F.substring(text, upto(i) + 1, e["start"] - upto(i)), e["shown"]))
    return F.when(F.size(edits) > 0, F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(edits, -1)["end"] + 1, F.length(text)))).otherwise(text)


def restored(text: Column, values: Column) -> Column:
    """The text with its placeholders replaced from a map, in one pass; unknown ones stay."""
    between, hits = F.split(text, PLACEHOLDER, -1), F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    parts = F.zip_with(between, hits, lambda b, h: F.concat(b, F.coalesce(F.try_element_at(values, h), h, F.lit(""))))
    return F.when(F.size(values) > 0, F.array_join(parts, "")).otherwise(text)


def json_inside(value: Column) -> Column:
    """The text as it stands inside the quotes of a JSON string."""
    quoted = F.to_json(F.array(value))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)


def guard_texts(rows: DataFrame, policy: GuardPolicy, memorized: frozenset[str], key: bytes, detectors: Sequence[D.Detector | str]) -> DataFrame:
    """rows (see keyed; a column json tells whether values put back must be escaped) with shown, blocked, n_masked, n_redacted, n_leaked, n_known."""
    found = found_values(rows, detectors)
    asked = found.where("request").withColumn("action", _action(F.col("entity_type"), policy.request_actions(), policy.inbound_default))
    stop = asked.where("action = 'block'").select("row_key").distinct()
    tokens = placeholders(asked.where("action = 'mask'").join(stop, "row_key", "left_anti"))
    asked = asked.join(tokens.drop("since"), ["conversation", "entity_type", "value"], "left").withColumns({"leaked": F.lit(False), "known": F.lit(False)})

    said = found.where("not request")
    named = tokens.groupBy("conversation", "value").agg(F.min("since").alias("since"))
    new = said.join(named, ["conversation", "value"], "left").where("since is null or since >= at")
    print_of = fingerprint(key)(F.col("entity_type"), F.col("value"))
    new = new.withColumn("known", print_of.isin(*memorized) if memorized else F.lit(False))
    new = new.withColumn("action", F.when(F.col("known"), policy.memorized).otherwise(_action(F.col("entity_type"), policy.reply_actions(), "allow")))
    new = new.withColumns({"token": F.lit(None).cast("string"), "leaked": F.lit(True)})

    columns = ["row_key", "start", "end", "entity_type", "value", "action", "token", "leaked", "known"]
    mask, redact = (F.col("action") == "mask") & ~F.col("leaked"), F.col("action").isin("redact", "mask")
    shown = F.when(mask, F.coalesce("token", F.lit(""))).when(redact, F.concat(F.lit("["), "entity_type", F.lit("]"))).otherwise(F.col("value"))
    count = lambda c: F.count(F.when(c, 1))
    done = asked.select(*columns).union(new.select(*columns)).withColumn("shown", shown).groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "shown"))).alias("edits"), F.max(F.col("action") == "block").alias("blocked"),
        count(mask).alias("n_masked"), count(redact & ~mask).alias("n_redacted"), count(F.col("leaked")).alias("n_leaked"), count(F.col("known")).alias("n_known"),
    )
    # what a reply's own placeholders stand for
    used = rows.where("not request").select("row_key", "conversation", "at", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0)))).alias("token")).distinct()
    back = used.join(tokens, ["conversation", "token"]).where("since < at").groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("back"))

    out = rows.join(done, "row_key", "left").join(back, "row_key", "left")
    values = F.when(F.col("json"), F.transform_values("back", lambda _, v: json_inside(v))).otherwise(F.col("back"))
    text = edited(F.col("text"), F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,shown:string>>")))
    blocked = F.coalesce("blocked", F.lit(False))
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_masked", "n_redacted", "n_leaked", "n_known")}
    return out.withColumns({"shown": F.when(blocked, "").otherwise(F.when(F.col("back").isNull(), text).otherwise(restored(text, values))), "blocked": blocked, **counts}).drop("edits", "back")


def _outcome() -> Column:
    return F.when(F.col("blocked"), "blocked").when(F.col("n_masked") + F.col("n_redacted") + F.col("n_known") > 0, "protected").otherwise("passed")


def guard_conversations(turns: DataFrame, policy: GuardPolicy = GuardPolicy(), memorized: frozenset[str] = frozenset(), key: bytes = b"", detectors: Sequence[D.Detector | str] = ("patterns",)) -> DataFrame:
    """conv_id, turn, role, text as the other side may see it, outcome, n_masked, n_redacted, n_leaked: one row for each row of turns(conv_id, turn, role, text)."""
    rows = keyed(turns.select("conv_id", "turn", "role", "text")).withColumn("json", F.lit(False))
    out = guard_texts(rows, policy, memorized, key, detectors)
    unless = lambda c: F.when(F.col("blocked"), 0).otherwise(F.col(c)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", F.col("shown").alias("text"), _outcome().alias("outcome"), unless("n_masked"), unless("n_redacted"), "n_leaked")


# --- chat documents -------------------------------------------------------------------------------
NOTE = "Placeholders such as [EMAIL_1] in this conversation stand for personal details; repeat them unchanged."
_PIECES = "chat string, role string, turn long, path string, text string, json boolean"
#: documents that a task holds as Python objects at once; an Arrow batch has thousands, and its texts stay in Arrow until then
_AT_ONCE = 128


def _messages(document: object) -> list:
    """The messages of a request, or those of a completion's choices."""
    if not isinstance(document, dict):
        return []
    if isinstance(document.get("messages"), list):
        return document["messages"]
    choices = document.get("choices")
    return [c.get("message") if isinstance(c, dict) else None for c in choices] if isinstance(choices, list) else []


def _strings(document: object):
    """(path, holder, key, whether its text is itself JSON) of each text that the guard looks at: contents, text parts, arguments of tool calls."""
    for i, m in enumerate(_messages(document)):
        if not isinstance(m, dict):
            continue
        content, calls = m.get("content"), m.get("tool_calls")
        if isinstance(content, str):
            yield f"{i}", m, "content", False
        for j, part in enumerate(content if isinstance(content, list) else []):
            if isinstance(part, dict) and part.get("type") == "text" and isinstance(part.get("text"), str):
                yield f"{i}.{j}", part, "text", False
        for j, call in enumerate(calls if isinstance(calls, list) else []):
            function = call.get("function") if isinstance(call, dict) else None
            if isinstance(function, dict) and isinstance(function.get("arguments"), str):
                yield f"{i}#{j}", function, "arguments", True


def _loaded(text: str | None) -> object:
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def piece_maker(role: str, turn: int):
    """A row of _PIECES for each text of (chat, document) that the guard looks at, some documents at a time."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                chats, documents = (c.to_pylist() for c in batch.slice(at, _AT_ONCE).columns)
                rows = [(chat, role, turn + n, p, holder[k], j) for chat, d in zip(chats, documents, strict=True) for n, (p, holder, k, j) in enumerate(_strings(_loaded(d)))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chat", "role", "turn", "path", "text", "json"])

    return run


def rewriter(note: str, sides: Sequence[str], keep: Sequence[str]):
    """The columns keep, then for each side its document with its edits, the first side with the note where masked; some documents at a time."""

    def one(text: str | None, edits, masked: bool) -> str | None:
        document, shown = _loaded(text), {} if edits is None else {e["path"]: e["shown"] for e in edits}
        for path, holder, k, _ in _strings(document):
            holder[k] = shown.get(path, "")
        if masked and isinstance(document, dict) and isinstance(document.get("messages"), list):
            document["messages"] = [{"role": "system", "content": note}, *document["messages"]]
        return json.dumps(document, ensure_ascii=False) if isinstance(document, dict) else None

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                rows = batch.slice(at, _AT_ONCE)
                column = lambda name: rows.column(rows.schema.get_field_index(name))  # noqa: B023, E731
                masked = column("masked").to_pylist()
                new = []
                for place, side in enumerate(sides):
                    flags = masked if place == 0 else [False] * len(masked)
                    new.append(pa.array([one(d.as_py(), e.as_py(), m) for d, e, m in zip(column(side), column(f"{side}_edits"), flags, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*map(column, keep), *new], names=[*keep, *[f"{s}_new" for s in sides]])

    return run


def guard_chats(chats: DataFrame, policy: GuardPolicy = GuardPolicy(), memorized: frozenset[str] = frozenset(), key: bytes = b"", detectors: Sequence[D.Detector | str] = ("patterns",), note: str = NOTE) -> DataFrame:
    """chat_id, request, completion as the other side may see them, request_outcome, completion_outcome of chats(chat_id, request, completion).

    Both are JSON texts of the usual chat form: contents as text or in parts, and tool calls whose arguments are JSON inside a text, where values are put
    back escaped.  A masked request starts with a note on placeholders.  A blocked side is null, and with it the reply to a blocked request.
    Null, unreadable and other texts than objects give null and the outcome ``unreadable``; equal chats share their placeholders.
    """
    chats = chats.select("chat_id", "request", "completion")
    chats = chats.withColumn("chat", F.sha2(F.to_json(F.struct("chat_id", "request", "completion")).cast("binary"), 256))
    side = lambda name, role, turn: chats.select("chat", name).mapInArrow(piece_maker(role, turn), _PIECES)
    pieces = side("request", "user", 0).union(side("completion", "assistant", 1 << 40))
    rows = keyed(pieces.withColumnRenamed("chat", "conv_id"))
    done = guard_texts(rows, policy, memorized, key, detectors)
    some = lambda role: F.col("role") == role
    edits = lambda role: F.collect_set(F.when(some(role), F.struct("path", "shown")))
    total = lambda role, c: F.coalesce(F.sum(F.when(some(role), F.col(c))), F.lit(0))
    stop = lambda role: F.coalesce(F.max(F.when(some(role), F.col("blocked"))), F.lit(False))
    by_side = {"request": "user", "completion": "assistant"}
    sides = [x for n, r in by_side.items() for x in (edits(r).alias(f"{n}_edits"), stop(r).alias(f"{n}_blocked"), *[total(r, c).alias(f"{n}_{c}") for c in ("n_masked", "n_redacted", "n_known")])]
    joined = chats.join(done.groupBy(F.col("conv_id").alias("chat")).agg(*sides), "chat", "left")
    masked = F.coalesce(F.col("request_n_masked") > 0, F.lit(False))
    blocked = {n: F.coalesce(F.col(f"{n}_blocked"), F.lit(False)) for n in by_side}
    joined = joined.withColumn("masked", masked)
    keep = [f for f in joined.schema.fields if f.name not in {"chat", "masked", *by_side, *[f"{n}_edits" for n in by_side]}]
    schema = T.StructType([*keep, *[T.StructField(f"{n}_new", T.StringType()) for n in by_side]])
    joined = joined.drop("chat").mapInArrow(rewriter(note, list(by_side), [f.name for f in keep]), schema)
    gone = {"request": blocked["request"], "completion": blocked["request"] | blocked["completion"]}
    touched = lambda n: F.coalesce(sum((F.col(f"{n}_{c}") for c in ("n_masked", "n_redacted", "n_known")), F.lit(0)), F.lit(0)) > 0
    outcome = lambda n: F.when(F.col(f"{n}_new").isNull(), "unreadable").when(gone[n], "blocked").when(touched(n), "protected").otherwise("passed")
    return joined.select("chat_id", *[F.when(~gone[n], F.col(f"{n}_new")).alias(n) for n in by_side], *[outcome(n).alias(f"{n}_outcome") for n in by_side])
