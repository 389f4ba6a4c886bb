"""The guard: no unedited value for null or repeated turns, chats and tool calls, detectors as plug-ins."""

import json

import pytest
from pyspark.sql import functions as F

from veilmark.operators import detectors as D
from veilmark.operators import guard, text

TURNS = "conv_id long, turn long, role string, text string"
SSN = "078-05-1120"


def shown(spark, turns, **more):
    return sorted(((r.conv_id, r.turn, r.role, r.text, r.outcome, r.n_masked, r.n_leaked) for r in guard.guard_conversations(spark.createDataFrame(turns, TURNS), **more).collect()), key=str)


def test_null_keys(spark):
    turns = [(None, 1, "user", "I am a@b.io"), (None, 1, "assistant", "Hi [EMAIL_1]"), (1, None, "user", f"{SSN} c@d.io"), (1, None, "assistant", "[EMAIL_1] c@d.io"), (1, 2, "assistant", "[EMAIL_1] c@d.io"), (None, None, None, None), (2, 1, None, "x@y.io")]
    got = shown(spark, turns)
    want = [
        (None, 1, "user", "I am [EMAIL_1]", "protected", 1, 0),
        (None, 1, "assistant", "Hi [EMAIL_1]", "passed", 0, 0),  # not of this row's conversation
        (1, None, "user", "[SSN_1] [EMAIL_1]", "protected", 2, 0),
        (1, None, "assistant", "[EMAIL_1] c@d.io", "passed", 0, 1),  # not known to be earlier
        (1, 2, "assistant", "c@d.io c@d.io", "passed", 0, 0),
        (None, None, None, "", "passed", 0, 0),
        (2, 1, None, "[EMAIL_1]", "protected", 1, 0),
    ]
    assert got == sorted(want, key=str)


def test_repeated_turns(spark):
    long = "a much longer text of the same turn, without any"
    turns = [(1, 0, "user", "mail a@b.io"), (1, 0, "user", long), (1, 0, "user", "b@b.io, a@b.io"), (1, 0, "user", "mail a@b.io"), (1, 0, "assistant", f"{SSN} a@b.io")]
    got = shown(spark, turns)
    # a@b.io and b@b.io: by turn, then place in their text
    want = [(1, 0, "user", "mail [EMAIL_2]", "protected", 1, 0)] * 2 + [(1, 0, "user", long, "passed", 0, 0), (1, 0, "user", "[EMAIL_1], [EMAIL_2]", "protected", 2, 0), (1, 0, "assistant", "[SSN] a@b.io", "protected", 0, 2)]
    assert got == sorted(want, key=str)
    everything = " ".join(r[3] for r in shown(spark, [(None, i % 2, "user", f"u{i}@x.io {SSN}") for i in range(40)]))
    assert "@" not in everything and SSN not in everything


def test_policies(spark):
    turns = [(1, 0, "user", f"{SSN} a@b.io 2024-01-05"), (1, 1, "assistant", "see z@z.io"), (1, 2, "user", "a@b.io")]
    assert [r[3:5] for r in shown(spark, turns, policy=guard.GuardPolicy(inbound={"SSN": "block"}))] == [("", "blocked"), ("see z@z.io", "passed"), ("[EMAIL_1]", "protected")]
    assert shown(spark, turns, policy=guard.GuardPolicy(inbound={"DATE": "redact"}, inbound_default="allow"))[0][3] == f"{SSN} a@b.io [DATE]"
    assert shown(spark, turns, policy=guard.GuardPolicy(outbound={"EMAIL": "block"}))[1][3:5] == ("", "blocked")
    mark = spark.range(1).select(text.fingerprint(b"k")(F.lit("EMAIL"), F.lit("z@z.io"))).first()[0]
    assert shown(spark, turns, memorized=frozenset({mark}), key=b"k")[1][3:5] == ("see [EMAIL]", "protected")
    # a value that looks like a placeholder is put back as it is, in one pass
    odd = [(1, 0, "user", "NAME1"), (1, 0, "user", "[EMAIL_1]"), (1, 1, "assistant", "[CODE_1] [CODE_2]")]
    detector = D.pattern_detector("odd", "CODE", r"NAME1|\[EMAIL_1\]")
    assert shown(spark, odd, detectors=(detector,))[-1][3] == "NAME1 [EMAIL_1]"


def test_detectors(spark):
    names = D.listed_detector("names", {"Ada Byron": "FULLNAME", "Ada": "FIRSTNAME", "ada@b.io": "NICK"})
    df = spark.createDataFrame([(1, "Ada Byron, Ada: ada@b.io"), (2, None), (3, ""), (4, "Adam 10.0.0.1"), (5, "aa:bb:cc:dd:ee:ff:aa:bb")], "id int, text string")
    find = lambda *d: {r.id: [(e.start, e.end, e.entity_type) for e in r.entities] for r in text.detect_records(df, detectors=d).collect()}
    assert find("patterns", names) == {1: [(0, 9, "FULLNAME"), (11, 14, "FIRSTNAME"), (16, 24, "EMAIL")], 2: [], 3: [], 4: [(5, 13, "IPV4")], 5: [(0, 23, "IPV6")]}
    assert find(names, "patterns")[1][2] == (16, 24, "NICK")
    column = {r.id: [tuple(e) for e in r.s] for r in df.select("id", text.detect(F.col("text")).alias("s")).collect()}
    assert column == {1: [(16, 24, "EMAIL")], 2: [], 3: [], 4: [(5, 13, "IPV4")], 5: [(0, 23, "IPV6")]}
    masked = text.sanitize(text.detect_records(df, detectors=(names,)), "mask").where("id = 1").first().text
    assert masked == "[FULLNAME], [FIRSTNAME]: [NICK]"
    assert shown(spark, [(1, 0, "user", "Ada, Ada Byron"), (1, 1, "assistant", "Dear [FIRSTNAME_1]")], detectors=(names,))[-1][3] == "Dear Ada"
    broken = D.Detector("broken", lambda t: [(3, 3, "A"), (-1, 2, "A"), (0, 99, "A"), (2, 5, "A"), (0, 3, "A")])
    assert D.merged([broken], "abcdefg") == [(0, 3, "A")] and D.merged([broken], None) == []
    with pytest.raises(ValueError, match="unknown"):
        text.detect(F.col("text"), ("nope",))
    D.register(names)
    with pytest.raises(ValueError, match="another"):
        D.register(D.listed_detector("names", {"x": "Y"}))


def test_table_function(spark):
    D.register(D.pattern_detector("codes", "CODE", r"c\d+"))
    D.register_table_function(spark)
    spark.createDataFrame([(1, "c1 a@b.io", "k"), (2, None, "l"), (3, "none", None)], "id int, body string, other string").createOrReplaceTempView("bodies")
    got = spark.sql("SELECT * FROM find_spans(TABLE(bodies), 'body', 'codes,patterns') ORDER BY start")
    assert got.columns == ["id", "body", "other", "start", "end", "entity_type"] and [tuple(r)[3:] for r in got.collect()] == [(0, 2, "CODE"), (3, 9, "EMAIL")]
    for wrong in ("'body', 'nope'", "'absent', 'codes'"):
        with pytest.raises(Exception, match="nope|absent"):
            spark.sql(f"SELECT * FROM find_spans(TABLE(bodies), {wrong})").collect()


def test_chats(spark):
    request = {"model": "m", "temperature": 1.0, "messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": [{"type": "text", "text": f"I am \"q\" a@b.io {SSN}"}, {"type": "image", "url": "a@b.io"}, 7]}, {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "f", "arguments": '{"to": "a@b.io"}'}}, {"id": 1}]}, "odd"]}
    completion = {"choices": [{"message": {"content": "[EMAIL_1], [SSN_1], [EMAIL_9], 4111 1111 1111 1111", "tool_calls": [{"function": {"arguments": '{"who": "[NICK_1]", "to": "[EMAIL_1]"}'}}]}}, None]}
    quoted = D.pattern_detector("quoted", "NICK", '"q"')
    rows = [(1, json.dumps(request), json.dumps(completion)), (2, "nope", None), (3, "[]", '{"choices": "x"}'), (None, '{"messages": [{"content": "z@z.io"}]}', '{"choices": [{"message": {"content": "[EMAIL_1]"}}]}')]
    df = spark.createDataFrame(rows, "chat_id long, request string, completion string")
    got = {r.chat_id: r for r in guard.guard_chats(df, detectors=(quoted, "patterns")).collect()}
    asked = json.loads(got[1].request)
    assert asked["temperature"] == 1.0 and asked["messages"][0] == {"role": "system", "content": guard.NOTE} and asked["messages"][1]["content"] == "be kind"
    assert asked["messages"][2]["content"] == [{"type": "text", "text": "I am [NICK_1] [EMAIL_1] [SSN_1]"}, {"type": "image", "url": "a@b.io"}, 7]
    assert asked["messages"][3]["tool_calls"] == [{"function": {"name": "f", "arguments": '{"to": "[EMAIL_1]"}'}}, {"id": 1}] and asked["messages"][4] == "odd"
    said = json.loads(got[1].completion)["choices"][0]["message"]
    assert said["content"] == f"a@b.io, {SSN}, [EMAIL_9], [CREDITCARDNUMBER]"
    assert json.loads(said["tool_calls"][0]["function"]["arguments"]) == {"who": '"q"', "to": "a@b.io"}  # escaped inside the arguments
    assert (got[1].request_outcome, got[1].completion_outcome) == ("protected", "protected")
    assert (got[2].request, got[2].completion, got[2].request_outcome, got[2].completion_outcome) == (None, None, "unreadable", "unreadable")
    assert got[3].request is None and json.loads(got[3].completion) == {"choices": "x"} and got[3].completion_outcome == "passed"
    assert "z@z.io" not in got[None].request and json.loads(got[None].completion)["choices"][0]["message"]["content"] == "z@z.io"
    stop = guard.guard_chats(df.where("chat_id = 1"), guard.GuardPolicy(inbound={"SSN": "block"})).first()
    assert (stop.request, stop.completion, stop.request_outcome, stop.completion_outcome) == (None, None, "blocked", "blocked")
    only = guard.guard_chats(df.where("chat_id = 1"), guard.GuardPolicy(outbound={"CREDITCARDNUMBER": "block"})).first()
    assert only.request is not None and only.completion is None and only.completion_outcome == "blocked"


def test_large_batches_of_chats_are_rewritten_some_at_a_time():
    """A batch's documents never all become Python objects at once, and none is lost."""
    import tracemalloc

    import pyarrow as pa

    documents = ['{"messages": [{"role": "user", "content": "%s"}]}' % (f"{i:05d} " + "x" * 4000) for i in range(3000)]
    chats = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(3000)]), pa.array(documents)], names=["chat", "request"])
    edits = pa.array([[{"path": "0", "shown": f"shown {i}"}] for i in range(3000)])
    joined = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(documents), edits, pa.array([i % 2 == 0 for i in range(3000)])], names=["chat_id", "request", "request_edits", "masked"])
    tracemalloc.start()
    turns = [t for b in guard.piece_maker("user", 5)([chats]) for t in b["turn"].to_pylist()]
    texts = [x[27:] for b in guard.rewriter("note", ["request"], ["chat_id"])([joined]) for x in b["request_new"].to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert turns == [5] * 3000 and len(texts) == 3000 and all(f"shown {i}" in x for i, x in enumerate(texts))
    assert most < 6_000_000  # the texts alone are 12 MB
