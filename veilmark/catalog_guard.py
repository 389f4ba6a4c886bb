"""Queries of span detectors and the guard over the documents; part of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, t
from .functions import patterns as P
from .operators import detectors, guard, text

#: e-mail addresses alone, a pattern that SQL engines read alike
MAIL = detectors.register(detectors.pattern_detector("mail", "EMAIL", P.EMAIL))

_V = rf"""WITH b AS (SELECT *, regexp_extract_all(text, '{P.EMAIL}') AS h, string_split_regex(text, '{P.EMAIL}') AS g FROM documents),
v AS (SELECT doc_id, doc_id // 20 AS conv_id, doc_id % 20 AS turn, doc_id % 4 <> 3 AS request, unnest(h) AS value, generate_subscripts(h, 1) AS i FROM b)"""


@query("detected_emails", _V + """ SELECT v.doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::INTEGER AS start,
 (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))))::INTEGER AS "end", 'EMAIL' AS entity_type FROM v JOIN b USING (doc_id)""")
def detected_emails(s, d):
    found = text.detect_records(t(s, d, "documents").select("doc_id", "text"), detectors=("mail",))
    return found.select("doc_id", F.inline("entities"))


@query("find_spans", _V + """ SELECT lang, length(value)::INTEGER AS size, count(*)::BIGINT AS n FROM v JOIN b USING (doc_id) GROUP BY 1, 2""")
def find_spans(s, d):
    """The table function from SQL."""
    detectors.register_table_function(s)
    t(s, d, "documents").createOrReplaceTempView("veilmark_documents")
    found = s.sql("SELECT lang, `end` - start AS size FROM find_spans(TABLE(SELECT lang, text FROM veilmark_documents), 'text', 'mail')")
    return found.groupBy("lang", "size").agg(F.count("*").alias("n"))


@query("guard_documents", _V + """,
k AS (SELECT conv_id, value, min(turn * 1000000 + i) AS f FROM v WHERE request GROUP BY 1, 2),
k2 AS (SELECT conv_id, value, f // 1000000 AS since, '[EMAIL_' || row_number() OVER (PARTITION BY conv_id ORDER BY f) || ']' AS token FROM k),
r AS (SELECT doc_id, list(CASE WHEN request THEN token ELSE value END ORDER BY i) AS s, count(*) FILTER (request) AS n_masked, count(*) FILTER (NOT request AND NOT coalesce(since < turn, false)) AS n_leaked
 FROM v LEFT JOIN k2 USING (conv_id, value) GROUP BY 1)
SELECT doc_id // 20 AS conv_id, doc_id % 20 AS turn, sha256(array_to_string([g[i] || coalesce(s[i], '') FOR i IN range(1, len(g) + 1)], '')) AS sha256,
 CASE WHEN coalesce(n_masked, 0) > 0 THEN 'protected' ELSE 'passed' END AS outcome, coalesce(n_masked, 0)::BIGINT AS n_masked, coalesce(n_leaked, 0)::BIGINT AS n_leaked FROM b LEFT JOIN r USING (doc_id)""")
def guard_documents(s, d):
    """Documents as turns of conversations, each fourth a reply; e-mail addresses are masked in requests and leak in replies."""
    turns = t(s, d, "documents").select(F.floor(F.col("doc_id") / 20).cast("long").alias("conv_id"), (F.col("doc_id") % 20).alias("turn"), F.when(F.col("doc_id") % 4 == 3, "assistant").otherwise("user").alias("role"), "text")
    out = guard.guard_conversations(turns, detectors=("mail",))
    return out.select("conv_id", "turn", F.sha2("text", 256).alias("sha256"), "outcome", "n_masked", "n_leaked")


@query("guard_chats", _V + """,
k AS (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n FROM v GROUP BY 1, 2),
w AS (SELECT doc_id, max(CASE WHEN n = 1 THEN value END) AS e1, max(CASE WHEN n = 2 THEN value END) AS e2 FROM k GROUP BY 1),
r AS (SELECT doc_id, list('[EMAIL_' || n || ']' ORDER BY i) AS s FROM v JOIN k USING (doc_id, value) GROUP BY 1)
SELECT doc_id AS chat_id, sha256(array_to_string([g[i] || coalesce(s[i], '') FOR i IN range(1, len(g) + 1)], '')) AS sha256, 'Write to ' || coalesce(e1, '[EMAIL_1]') || ' or ' || coalesce(e2, '[EMAIL_2]') AS reply,
 '{"to": "' || coalesce(e1, '[EMAIL_1]') || '"}' AS arguments, CASE WHEN e1 IS NULL THEN 'passed' ELSE 'protected' END AS request_outcome FROM b LEFT JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)""")
def guard_chats(s, d):
    """Each document as a part of a chat message; the reply names two placeholders in its text and one in a tool call."""
    part = F.struct(F.lit("text").alias("type"), F.col("text"))
    message = F.struct(F.lit("user").alias("role"), F.array(part).alias("content"))
    call = F.struct(F.struct(F.lit('{"to": "[EMAIL_1]"}').alias("arguments")).alias("function"))
    reply = F.struct(F.lit("Write to [EMAIL_1] or [EMAIL_2]").alias("content"), F.array(call).alias("tool_calls"))
    chats = t(s, d, "documents").select(F.col("doc_id").alias("chat_id"), F.to_json(F.struct(F.array(message).alias("messages"))).alias("request"), F.to_json(F.struct(F.array(F.struct(reply.alias("message"))).alias("choices"))).alias("completion"))
    out = guard.guard_chats(chats, detectors=("mail",))
    last = F.when(F.col("request_outcome") == "protected", 1).otherwise(0)  # behind the note
    messages = F.from_json("request", "messages array<struct<content string>>")["messages"]
    content = F.from_json(F.get(messages, last)["content"], "array<struct<text string>>")
    shown = F.from_json("completion", "choices array<struct<message struct<content string, tool_calls array<struct<function struct<arguments string>>>>>>")["choices"][0]["message"]
    return out.select("chat_id", F.sha2(content[0]["text"], 256).alias("sha256"), shown["content"].alias("reply"), shown["tool_calls"][0]["function"]["arguments"].alias("arguments"), "request_outcome")
