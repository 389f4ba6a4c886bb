"""Near-duplicate, passage and decontamination operators against brute force."""

import collections
import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from veilmark.llm import queries
from veilmark.llm.decontaminate import WinnowParams, benchmark_hits, drop_contaminated
from veilmark.llm.near_dedup import NearParams, drop_near_duplicates, near_duplicates
from veilmark.llm.passages import repeated_passages

SPACE = r"[\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split(SPACE, low(text)) if w]


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(sets, num, den):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sentence(r, n, size=400):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def family(seed=0):
    """A chain of edits, a crowd of copies with one to four edits each, exact copies, short and empty texts."""
    r = random.Random(seed)
    base, rows = sentence(r, 120), []
    for edits in (0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 1, 0, 0):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(120)] = f"e{r.randrange(10**6)}"
        rows.append(" ".join(w))
    chain = sentence(r, 100)
    for i in range(6):
        chain[10 * i + 3] = f"c{i}"
        rows.append(" ".join(chain).upper() if i % 2 else "\t".join(chain))
    rows += ["one two", "ONE  two", "one two three", "", None, "  \n", *[" ".join(sentence(r, 60)) for _ in range(12)]]
    return list(enumerate(rows))


def test_near_duplicates_match_brute_force(spark):
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (80, 85, 95):
        got = {r.doc_id: r for r in near_duplicates(spark, df, NearParams(num=num)).collect()}
        sets = {i: shingles(t) for i, t in rows}
        want = components(sets, num, 100)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "x"), (2, "y")], "doc_id long, text string").withColumn("signature", F.lit("clash")).withColumn("n_shingles", F.lit(7))
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(spark, df).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("2", 2, True), ("None", None, True)]
    assert near_duplicates(spark, df.limit(0)).count() == 0


def test_repeated_ids_keep_their_links(spark):
    """Two unrelated texts under each id, and a near copy of each text: every row reaches the smallest id of its own text."""
    r, rows, want = random.Random(3), [], {}
    for i in range(40):
        for t in range(2):
            base = sentence(r, 100, 10**6)
            near = list(base)
            near[50] = "edit"
            a, b = i, 1000 + 2 * i + t
            rows += [(a, " ".join(base)), (b, " ".join(near))]
            want[b] = a
    got = {x.doc_id: x for x in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {b: got[b].component_id for b in want} == want and not any(got[b].kept for b in want)


def test_drop_near_duplicates_keeps_one_row_of_each_group(spark):
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (None, text, "c"), (None, other, "d"), (None, other, "d"), (1, other + " x", "e"), (7, None, "f"), (7, "", "g"), (7, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string")
    out = drop_near_duplicates(spark, df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r["class"]) for r in out.collect()) == [("1", "a"), ("1", "e"), ("7", "f"), ("7", "g"), ("7", "g")]
    assert drop_near_duplicates(spark, df.limit(0)).count() == 0


def test_signature_is_a_minhash(spark):
    """With few coordinates and every pair of a threshold's width apart, links still equal brute force."""
    rows = family(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(spark, df, NearParams(coordinate_bits=5)).collect()}
    assert got == components({i: shingles(t) for i, t in rows}, 80, 100)


def test_query_on_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = components({r.doc_id: shingles(r.text) for r in rows}, 85, 100)
    assert {r.doc_id: r.component_id for r in queries.op2_near_dedup(spark, sf).collect()} == want


def test_passages(spark):
    r = random.Random(1)
    shared, hot, near = sentence(r, 55), sentence(r, 13), sentence(r, 90)
    rows = [(i, sentence(r, 40 + i, 5000)) for i in range(30)]
    for i in range(0, 20):
        rows[i][1][5:5] = hot  # common to many, but short
    for i in (3, 7, 21):
        rows[i][1][10:10] = shared
    edited = list(near)
    edited[45] = "edit"
    rows[25][1][2:2], rows[28][1][7:7] = near, edited
    rows = [(i, " ".join(w)) for i, w in rows] + [(100, None), (101, ""), (102, "short text"), (None, " ".join(shared))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("start", F.lit(2))
    found = repeated_passages(spark, df).collect()
    assert {x for f in found for x in (f.doc_id, f.other_id)} == {3, 7, 21, 25, 28}
    text = dict(rows)
    for f in found:
        assert f.end - f.start >= 50
        if {f.doc_id, f.other_id} <= {3, 7, 21}:
            assert words(text[f.doc_id])[f.start : f.end] == words(text[f.other_id])[f.other_start : f.other_end]
    assert repeated_passages(spark, df.limit(0)).count() == 0


def test_passage_query_finds_every_exact_repeat(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    seen = collections.defaultdict(set)
    for r in rows:
        w = words(r.text)
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(r.doc_id)
    want = {i for s in seen.values() if len(s) > 1 for i in s}
    got = {x for f in queries.op6_substring_dedup(spark, sf).collect() for x in (f.doc_id, f.other_id)}
    assert want <= got


def contaminated(docs, items, size=13):
    pick = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for item, t in items:
        w = pick(t) if t else []
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(item))
    out = {}
    for i, t in docs:
        w, hit, found = pick(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    found |= windows[tuple(w[j : j + n])]
                    hit |= set(range(j, j + n))
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_in_one_block_and_many(spark):
    r = random.Random(2)
    items = [(10 * i, " ".join(sentence(r, n))) for i, n in enumerate((30, 13, 14, 5, 1, 40))] + [(70, None), (80, "?!"), (90, "")]
    docs = []
    for i in range(25):
        w = sentence(r, 60)
        if i % 3 == 0:
            own = items[i % 6][1].split()
            w[5:5] = own[: max(3, len(own) - i % 4)]
        docs.append((i, ", ".join(w).upper() if i % 2 else " ".join(w)))
    docs += [(98, None), (99, "...")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, "w1 w2")], "item_id long, text string")
    want = contaminated(docs, items)
    for block in (16_000_000, 120):
        got = {x.doc_id: (x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in benchmark_hits(spark, d, b, WinnowParams(block_bytes=block)).collect()}
        assert got == want
    assert all(not x.contaminated for x in benchmark_hits(spark, d, b.limit(0)).collect())
    rows = spark.createDataFrame([(None, items[0][1], 1), (None, "clean text", 2), (3, items[0][1], 3), (3, "clean", 4)], "doc_id long, text string, items int")
    assert sorted(x["items"] for x in drop_contaminated(spark, rows, b).collect()) == [2, 4]


def test_decontamination_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in queries.op9_decontaminate(spark, sf).collect():
        n, hit, found, bad = contaminated([d for d in docs if d[0] == r.doc_id], items)[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), bad)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        if r.doc_id > 40:
            break


def test_compact_windows_hold_every_subsequence():
    import numpy as np

    from veilmark.llm.passage_kernels import compact_windows

    r = np.random.default_rng(0)
    for _ in range(60):
        sizes, w = r.integers(1, 40, 3), int(r.integers(1, 9))
        v = r.integers(1, r.integers(3, 40), sizes.sum()).astype(np.uint64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        nodes = list(zip(*compact_windows(v, starts, ends, w), strict=True))
        assert all(b - a >= w and v[c] == v[a:b].min() for a, c, b in nodes)
        for s, e in zip(starts, ends, strict=True):
            for i in range(s, e):
                for j in range(i + w, e + 1):
                    assert any(s <= a <= i <= c < j <= b <= e and v[c] == v[i:j].min() for a, c, b in nodes)


def test_very_long_and_monotonous_texts(spark):
    long = "same " * 300_000
    df = spark.createDataFrame([(1, long), (2, long + "end"), (3, "x" * 2_000_000), (4, "a b " * 100_000)], "doc_id long, text string")
    found = {(f.doc_id, f.other_id) for f in repeated_passages(spark, df).collect()}
    assert found == {(2, 1)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, df).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 3), 4: (2, 4)}
    assert {r.doc_id: r.n_words for r in benchmark_hits(spark, df, df.selectExpr("doc_id as item_id", "'q q q' as text")).collect()}[1] == 300_000


def near_words(r, n):
    return [f"u{r.randrange(10**9)}" for _ in range(n)]


def test_like_passages_with_an_edit_at_every_place():
    import numpy as np

    from veilmark.llm import textscan as ts
    from veilmark.llm.passage_kernels import passages
    from veilmark.llm.passages import PassageParams

    r, p = random.Random(8), PassageParams()
    code = lambda w: ts.grams(np.array([hash(x) & (2**63 - 1) for x in w], dtype=np.uint64), 5)
    for size in (55, 60, 90):
        base = near_words(r, size)
        for at in range(size):
            for kind in ("replace", "insert", "delete"):
                other = base[:at] + ([] if kind == "delete" else near_words(r, 1)) + base[at + (kind != "insert") :]
                a, b = shingles(" ".join(base)), shingles(" ".join(other))
                if len(a & b) >= 0.8 * len(a | b):
                    got = passages(code(near_words(r, 9) + base + near_words(r, 9)), code(near_words(r, 4) + other + near_words(r, 9)), [], p)
                    assert got and max(f[1] - f[0] for f in got) >= size - 6, (size, at, kind)


def linked(found):
    classes = collections.defaultdict(set)
    for f in found:
        classes[f.class_id] |= {f.doc_id, f.other_id}
    return {(a, b) for c in classes.values() for a in c for b in c if a > b}


def test_every_two_documents_of_a_passage_are_linked(spark):
    r = random.Random(9)
    common, longer, inner = near_words(r, 45), near_words(r, 15), near_words(r, 55)
    outer = near_words(r, 30) + inner + near_words(r, 30)
    pad = lambda: near_words(r, 60)
    # 1 to 8 share a clause, 4 and 5 go on alike; 20 and 22 to 24 share what lies inside a longer passage of 22 and 23
    rows = [(i, pad() + common + (longer if i in (4, 5) else []) + pad()) for i in range(1, 9)]
    rows += [(20, pad() + inner + pad()), (22, pad() + outer + pad()), (23, pad() + outer + pad()), (24, pad() + inner + pad())]
    edited = [*outer[:40], "edit", *outer[40:]]
    rows += [(30, pad() + edited + pad())]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = repeated_passages(spark, df).collect()
    want = {(b, a) for a in (20, 22, 23, 24, 30) for b in (20, 22, 23, 24, 30) if a < b}
    assert {(5, 4)} <= linked(found) <= {(5, 4)} | want
    assert {(b, a) for a, b in [(20, 22), (20, 23), (20, 24), (22, 23), (22, 24), (23, 24)]} <= linked(found)
    assert any(f.doc_id == 30 and not f.exact and f.end - f.start >= 110 for f in found)


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        at, kind = r.randrange(len(out)), r.choice(["replace", "insert", "delete"])
        out[at : at + (kind != "insert")] = [] if kind == "delete" else near_words(r, 1)
    return out


def test_near_passages_and_hubs(spark):
    """Near copies at three lengths, and pairs that share a passage around a phrase that many other texts have."""
    r, rows, planted = random.Random(12), [], []
    pad = lambda: near_words(r, r.randrange(20, 70))

    def put(words):
        rows.append((len(rows), pad() + words + pad()))
        return len(rows) - 1

    for n, edits in ((60, 1), (120, 2), (200, 4)):
        for _ in range(40):
            base = near_words(r, n)
            while True:
                other = edited(r, base, edits)
                a, b = shingles(" ".join(base)), shingles(" ".join(other))
                if len(a & b) >= 0.8 * len(a | b):
                    break
            planted.append(((n, edits), put(base), put(other)))
    exact = []
    for phrase_words in (20, 35, 44):
        phrase = near_words(r, phrase_words)
        for _ in range(30):
            put(phrase)
        for _ in range(10):
            before, after = near_words(r, 30), near_words(r, 30)
            planted.append((("hub", phrase_words), put(before + phrase + after), put(edited(r, before, 1) + phrase + after)))
            side = near_words(r, 52 - phrase_words)
            exact.append((put(phrase + side), put(phrase + side)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    links = linked(repeated_passages(spark, df).collect())
    assert all((b, a) in links for a, b in exact)
    caught = collections.defaultdict(list)
    for kind, a, b in planted:
        caught[kind].append((b, a) in links)
    assert all(sum(x) >= 0.9 * len(x) for x in caught.values()), {k: sum(x) / len(x) for k, x in caught.items()}


def test_passages_do_not_depend_on_partitions(spark):
    r = random.Random(13)
    base = near_words(r, 150)
    rows = [(i, " ".join(near_words(r, 5 * i) + edited(r, base, i % 3) + ["the"] * (7 * (i % 11)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two, three = (sorted(map(tuple, repeated_passages(spark, df.repartition(n, F.xxhash64("doc_id", F.lit(n)))).collect())) for n in (1, 3, 11))
    assert one and one == two == three


def test_prefixes_of_like_nodes_share_enough_entries():
    import numpy as np
    import pyarrow as pa

    from veilmark.llm.passage_kernels import prefix_maker
    from veilmark.llm.passages import PassageParams

    r, nodes = np.random.default_rng(5), []
    for _ in range(120):
        held = r.choice(60, int(r.integers(4, 40)), replace=False)
        nodes.append((set(held.tolist()), int(r.integers(1, len(held) + 1))))
    n = {e: sum(e in a for a, _ in nodes) for e in range(60)}
    held = [[{"n": n[e], "entry": e, "at": 0, "wanted": True} for e in a] for a, _ in nodes]
    columns = {"node": range(120), "grp": [1] * 120, "late": [True] * 120, "size": [91] * 120, "need": [x for _, x in nodes]}
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns.values()] + [pa.array(held)], names=[*columns, "held"])
    taken, enough = collections.defaultdict(set), {}
    for out in prefix_maker(PassageParams())(iter([batch])):
        for x in out.to_pylist():
            taken[x["node"]].add(x["entry"])
            enough[x["node"]] = x["enough"]
    meet, one, like = set(), set(), set()
    for a in range(120):
        for b in range(a):
            both = len(taken[a] & taken[b])
            one |= {(a, b)} if both else set()
            meet |= {(a, b)} if both >= max(enough.get(a, 1), enough.get(b, 1)) else set()
            like |= {(a, b)} if len(nodes[a][0] & nodes[b][0]) >= max(nodes[a][1], nodes[b][1]) else set()
    assert like and like <= meet and len(meet) < len(one)


def test_members_that_share_too_few_entries_do_not_meet(spark):
    from veilmark.llm.passages import _all_meetings

    rows = [(e, n, True, n, k) for n, k, es in ((1, 4, (1, 2, 3, 4, 5)), (2, 4, (2, 3, 4, 5)), (3, 4, (3, 4, 5)), (4, 1, (5,)), (5, 1, (6,)), (6, 1, (6, 7))) for e in es]
    mixed = spark.createDataFrame(rows, "entry long, node long, late boolean, component long, enough int")
    assert {(x.node, x.other) for x in _all_meetings(mixed).collect()} == {(2, 1), (6, 5)}


def test_passages_of_many_pairs_at_once_equal_those_of_each():
    import numpy as np

    from veilmark.llm.passage_kernels import like_passages, passages
    from veilmark.llm.passages import PassageParams

    r, p = np.random.default_rng(6), PassageParams()
    flat = lambda parts: (np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    xs = [r.integers(0, int(r.choice([3, 40, 5000])), int(r.integers(0, 200))).astype(np.uint64) for _ in range(200)]
    ys = [np.delete(x, r.integers(0, len(x), 2)) if len(x) else x for x in xs]
    shifts = [np.array(sorted({0, int(r.integers(-5, 5))})) for _ in xs]
    got = [[] for _ in xs]
    for q, found in like_passages(*flat(xs), *flat(ys), *flat(shifts), p):
        got[q].append(found)
    assert any(got) and got == [passages(x, y, d, p) for x, y, d in zip(xs, ys, shifts, strict=True)]


def needs(text, at):
    """need of nodes at the places, as context_maker gives it."""
    import numpy as np
    import pyarrow as pa

    from veilmark.llm.passage_kernels import context_maker
    from veilmark.llm.passages import PassageParams

    words = np.array([hash(w) & 0x7FFFFFFF for w in text], dtype=np.int32)
    held = [{"grp": 1, "node": i, "c": c, "late": True} for i, c in enumerate(at)]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([words.tolist()], pa.list_(pa.int32())), pa.array([held])], names=["doc_id", "words", "nodes"])
    return [need for _, need in sorted({(x["node"], x["need"]) for out in context_maker(PassageParams())(iter([batch])) for x in out.to_pylist()})]


def test_runs_of_one_word_need_more_than_that_word():
    r = random.Random(4)
    pad = near_words(r, 60)
    assert needs(pad + ["of"] * 70 + pad, (10, 90, 95)) == [37, 3, 3]  # 50 equal words are an exact passage
    assert needs(["a", "b"] * 60, (30, 31)) == [2, 2]  # two words in turn may begin with either
    text = [r.choice("ab") for _ in range(30)] + ["c"] * 20 + [r.choice("abcdefgh") for _ in range(60)]
    for c in (40, 60, 80):
        part = [tuple(text[i : i + 5]) for i in range(len(text) - 4)][max(0, c - 45) : c + 46]
        least = min(len(set(part[s : s + 46])) for s in range(len(part) - 45))
        assert needs(text, (c,)) == [-(-max(3, least) * 80 // 100)]


def test_members_meet_where_a_passage_may_hold_both_anchors(spark):
    from veilmark.llm.passages import PassageParams, _likely_meetings

    some, every, odd = range(3, 80), range(91), range(1, 91, 2)
    rows = []

    def put(node, doc, group, places, rest=()):
        bits = [sum(1 << at % 62 for at in rest if at // 62 == i) for i in range(2)]
        rows.extend((100 * group + at, node, node % 10 > 1, 4, at, True, *bits, doc, node) for at in places)

    # 2 has a passage with 1, 3 only every other shingle of it, 4 lies in the document of 1
    put(1, 10, 1, every)
    put(2, 20, 1, some)
    put(3, 30, 1, odd)
    put(4, 10, 1, some)
    # what was not looked up may be in common
    put(11, 40, 2, odd, range(0, 91, 2))
    put(12, 50, 2, odd, range(0, 91, 2))
    mixed = spark.createDataFrame(rows, "entry long, node long, late boolean, enough int, at int, told boolean, rest0 long, rest1 long, doc_id long, component long")
    assert {(x.node, x.other) for x in _likely_meetings(mixed, PassageParams()).collect()} == {(2, 1), (4, 2), (12, 11)}


def keys_of(nodes):
    """{node: {entry: sharp}} as key_maker gives it, of (entry by place, need) each."""
    import pyarrow as pa

    from veilmark.llm.passage_kernels import key_maker
    from veilmark.llm.passages import PassageParams

    n = collections.Counter(e for held, _ in nodes for e in held.values())
    held = [[{"n": n[e], "entry": e, "at": at, "wanted": True} for at, e in held.items() if n[e] > 1] for held, _ in nodes]
    columns = [pa.array(range(len(nodes))), pa.array([True] * len(nodes)), pa.array([need for _, need in nodes]), pa.array(held)]
    out = collections.defaultdict(dict)
    for batch in key_maker(PassageParams())(iter([pa.RecordBatch.from_arrays(columns, names=["node", "late", "need", "held"])])):
        for x in batch.to_pylist():
            out[x["node"]][x["entry"]] = x["sharp"]
    return out


def test_like_nodes_share_a_key():
    """Copies of one text with edits: whatever passage over the anchor two of them share, they have a key in common."""
    r, like, kept, meet = random.Random(14), 0, 0, 0
    for edits in (1, 2, 3, 5):
        nodes = []
        for i in range(24):
            lost = {q for _ in range(r.randrange(edits + 1)) for c in [r.randrange(-4, 91)] for q in range(c, c + 5)} - {45}
            nodes.append(({q: 1000 * (i + 1) + q if q in lost else q for q in range(91)}, 37))
        keys = keys_of(nodes)
        for a in range(24):
            kept += len(keys[a])
            for b in range(a):
                both = [0, *itertools.accumulate(nodes[a][0][q] == nodes[b][0][q] for q in range(91))]
                spans = [(t - s, both[t] - both[s]) for s in range(46) for t in range(s + 46, 92)]
                some, sharp = keys[a].keys() & keys[b].keys(), {e for e, x in keys[a].items() if x and keys[b].get(e)}
                assert some or not any(100 * c >= 80 * n for n, c in spans)
                # both sides have 46 different shingles at least
                found = any(100 * c >= 80 * max(n, 46) and 100 * c >= 80 * (n + 46 - c) for n, c in spans)
                assert sharp or not found
                like += found
                meet += bool(sharp)
    assert like > 200 and meet < 4 * 24 * 23 // 2 and kept < 4 * 24 * 30


def test_runs_of_one_word_have_no_key_in_common():
    """Nodes of a group that share the shingle of its run alone do not meet."""
    nodes = [({45: 1, 46: 10 * i, 47: 10 * i + 1, 48: 10 * i + 2, 44: 5000 + i // 2, 43: 6000 + i // 2}, 3) for i in range(1, 21)]
    keys = keys_of(nodes)
    common = {(a, b) for a in range(20) for b in range(a) if keys[a].keys() & keys[b].keys()}
    assert common == {(a, b) for a in range(20) for b in range(a) if (a + 1) // 2 == (b + 1) // 2}


def test_edits_near_every_common_anchor(spark):
    """Short texts with an edit so near their start that few common minima have many equal words on one side."""
    r, rows = random.Random(21), []
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    for n, at in ((50, 15), (52, 16)):
        for _ in range(60):
            base = [word() for _ in range(n)]
            rows += [base, [*base[:at], word(), *base[at + 1 :]]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    links = linked(repeated_passages(spark, df).collect())
    assert sum((i + 1, i) in links for i in range(0, len(rows), 2)) >= 115


def test_equal_minima_of_many_texts_stay_apart():
    """Texts are told apart by 64 bits: with 32, some of many texts that share a beginning would count as equal."""
    import pyarrow as pa

    from veilmark.llm.passage_kernels import window_maker
    from veilmark.llm.passages import PassageParams

    r = random.Random(22)
    begin = near_words(r, 60)
    texts = [" ".join([*begin, f"end{i}"]) for i in range(3000)]
    marks = collections.defaultdict(set)
    for out in window_maker(PassageParams())(iter([pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["doc_id", "text"])])):
        for x in out.to_pylist():
            marks[x["mark"]].add(x["doc_id"])
    assert len(marks) == 3000 and max(m.bit_length() for m in marks) > 40
