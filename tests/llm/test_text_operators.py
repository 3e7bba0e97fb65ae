import base64
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailhead.llm import bpe, chat, decontaminate, quality, queries, sketches, token_counts, warc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
ENC = bpe.Encoder(RAW)
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op2_decontaminate", "op6_chat", "op7_warc"])
def test_query_equals_sql(spark, duck, name):
    rel = duck.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in rel.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(rel.fetchall(), key=key)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == want


# --- op 2


def hits_model(text, items, window=10):
    pat = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: pat.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        v = words(t)
        n = min(len(v), window)
        for k in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    names.add(name)
    return len(w), len(hit), sorted(names)


def test_marks_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "ÉTÉ", "x1"]) + rnd.choice(["", ",", "! "]) for _ in range(n))
    items = [(str(i), say(rnd.choice([1, 3, 9, 10, 11, 40]))) for i in range(12)] + [("95", "95"), ("e", ""), ("n", None), ("p", "the the the the the the the the the the the the")]
    docs = [say(rnd.randrange(0, 80)) for _ in range(40)] + [None, "", "the " * 30, "95 times", items[5][1] + " " + items[6][1] + " " + items[5][1]]
    docs += [f"zz {t} zz" for _, t in items if t]
    b = spark.createDataFrame(items, "item_id string, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = {i: hits_model(t, items) for i, t in enumerate(docs)}
    for size in (decontaminate.BLOCK_BYTES, 200):  # one block, and many
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.mark(d, b).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
        assert all(sum(y - x for x, y in r.hit_spans) == r.n_hit for r in got)


def test_marks_edge_cases(spark):
    b = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three")], "item_id long, text string")
    d = spark.createDataFrame([(1, "say one two three", 5), (1, "say one two three", 5), (2, None, 6)], "doc_id long, text string, n_hit int")
    got = decontaminate.mark(d, b).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(4, 3, ["1", "null"])] * 2 + [(0, 0, [])]
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns and [tuple(r) for r in clean.collect()] == [(2, None, 6)]
    assert decontaminate.mark(d.limit(0), b).isEmpty() and decontaminate.clean(d, b.limit(0)).count() == 3


# --- op 3 and op 5


def ids_of(texts):
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds, first = bpe.boundaries(data, off)
    toks = ENC.tokens(data.tobytes(), bounds)
    return [[i for t in toks[a:b] for i in t] for a, b in zip(first[:-1], first[1:])]


ODD = "aestmdrvlx'' \n\t\r !1٣é中 　​’-"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=ODD, max_size=60)), max_size=8))
def test_ids_equal_tiktoken(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(texts) == [TIK.encode_ordinary(t) for t in texts]


def test_ids_of_every_code_point_and_long_runs():
    for a in range(0, 0x110000, 0x8000):
        t = ["".join(f"a{chr(c)}b {chr(c)}" for c in range(a, a + 0x8000) if not 0xD800 <= c < 0xE000)]
        assert ids_of(t) == [TIK.encode_ordinary(t[0])]
    long = ["x" * 20000, "ab" * 9000 + "'s" * 3000, " " * 9000 + "x", "é" * 5001]
    assert ids_of(long) == [TIK.encode_ordinary(t) for t in long]


def test_encode_decode_round_trip(spark):
    texts = [None, "", "It's  a test\n\n’x", "日本語 " * 500, "é" * 30000, " \n"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    e = bpe.encode(df, PATH)
    rows = {r.doc_id: r for r in bpe.decode(e, PATH).collect()}
    ends = {r.doc_id: r.ends for r in e.collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == TIK.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode() and rows[i].text == t
        assert (ends[i] or [0])[-1] == len((t or "").encode())
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).isEmpty()
    with pytest.raises(Exception, match="do not belong"):
        bpe.decode(e.withColumn("ends", F.transform("ends", lambda x: x + 1)), PATH).collect()
    q = {r.doc_id: r for r in queries.op3_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = TIK.encode_ordinary(r.text)
        assert (q[r.doc_id].n_tokens, q[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert q[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_edited_trees_equal_fresh_ones():
    rnd = random.Random(3)
    say = lambda n: "".join(rnd.choice(ODD) for _ in range(n))
    for n in [0, 1, 5, 40, 300, 3000] * 25:
        t = say(n).encode()
        tree = token_counts.of_text(ENC, t)
        for _ in range(5):
            t = token_counts.apply(tree, ENC, t, rnd.randrange(len(t.decode()) + 2), rnd.choice([0, 1, 5, 50]), say(rnd.choice([0, 1, 3, 30])))
            fresh = token_counts.of_text(ENC, t)
            assert tree.total == fresh.total == len(TIK.encode_ordinary(t.decode()))
            assert [x for s, _ in tree.leaves for x in s] == [x for s, _ in fresh.leaves for x in s]
            k = rnd.randrange(len(t) + 1)
            assert tree.before(k) == fresh.before(k)


def test_edits_touch_little():
    t = ("lorem ipsum dolor sit amet " * 4000).encode()
    tree = token_counts.of_text(ENC, t)
    token_counts.apply(tree, ENC, t, 50_000, 3, "new")
    assert tree.encoded < 60


def test_counts_query_and_edge_cases(spark):
    for r in queries.op5_token_counts(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        n, t = len(r.text), r.text
        assert r.n_tokens == len(TIK.encode_ordinary(t))
        t = t[: n // 3] + " edited" + t[n // 3 :]
        t = t[: n // 2] + t[n // 2 + 8 :]
        t = t[: n * 2 // 3] + " \n\nit's 42" + t[n * 2 // 3 :]
        assert r.edited_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.edited_n_tokens == len(TIK.encode_ordinary(t))
    kind = "doc_id long, text string, e array<struct<at:int,removed:int,text:string>>, n_tokens string"
    df = spark.createDataFrame([(1, None, [(0, 0, "hi"), None]), (2, "abc", None), (3, "abc", [(99, 5, "!"), (-4, None, None)]), (3, "abc", [(0, 3, None)])], kind.rpartition(", ")[0]).withColumn("n_tokens", F.lit("mine"))
    n = lambda x: len(TIK.encode_ordinary(x))
    got = token_counts.count(df, PATH, edits_col="e").select("n_tokens", "edited_text", "edited_n_tokens").collect()
    assert [tuple(r) for r in got] == [(n(a), b, n(b)) for a, b in (("", "hi"), ("abc", "abc"), ("abc", "abc!"), ("abc", ""))]
    assert token_counts.count(df.limit(0), PATH, edits_col="e").isEmpty()


# --- op 6


def test_layouts_become_turns(spark):
    kind = "k int, prompt string, response string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, note string"
    rows = [
        (1, "p", "r", None, None, None, None, None, "x"), (2, None, None, "i", None, "o", None, None, None), (3, None, None, "i", "in", "o", None, None, None),
        (4, None, None, None, None, None, [("system", "s"), ("user", None)], None, None), (5, None, None, None, None, None, None, [("human", "h"), ("gpt", "g"), None], None),
        (6, "p", None, None, None, "o", None, None, None), (7, None, None, None, None, None, [], None, None),
    ]
    got = {}
    for r in chat.turns(spark.createDataFrame(rows, kind), "k").orderBy("k", "ord").collect():
        got.setdefault(r.k, []).append((r.role, r.text))
    assert got == {
        1: [("user", "p"), ("assistant", "r")], 2: [("user", "i"), ("assistant", "o")], 3: [("user", "i\n\nin"), ("assistant", "o")],
        4: [("system", "s"), ("user", "")], 5: [("user", "h"), ("assistant", "g"), ("", "")],
    }
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"]) != chat.fingerprint(["a"])


def test_turn_rows_go_through_a_layout(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "user", "a"), (1, "user", "a"), (2, "x", ""), (3, None, "b")], "k int, role string, text string")
    assert sorted(tuple(r) for r in chat.turns(df, "k", chat.TURN_ROWS).collect()) == [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "x", "")]
    assert [r.k for r in chat.unmatched(df, chat.TURN_ROWS).collect()] == [3]
    spark.createDataFrame([(7, 0, "user", "a"), (7, 1, None, None), (7, None, "user", "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen, own = [], chat.turns
    monkeypatch.setattr(chat, "turns", lambda df, key, layouts: seen.append(layouts) or own(df, key, layouts))
    got = {r.conv_id: r.n_turns for r in queries.op6_chat(spark, str(tmp_path)).collect()}
    assert got == {7: 3, -1: 2} and seen == [chat.TURN_ROWS]


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "\\", "\\\\</s>", "<\\/s>", "", "a\nb\\", "$1 \\1 é日", "<<SYS>>x<</SYS>>"]


def test_render_round_trip(spark):
    rows = [(c, t, r, x) for c, (t, r, x) in enumerate((0, r, x) for r in ("user", "assistant", "odd\nrole\\", "<|im_start|>") for x in NASTY)]
    rows += [(100, None, None, None), (100, 1, "assistant", "b"), (100, 1, "assistant", "b"), (100, 0, "assistant", "a"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"_at": F.lit(1), "piece": F.lit(2), "formatted": F.lit(3)})
    made = chat.render(df, "conv_id", "turn")
    for r in chat.read_back(made).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss_text == "".join(x[3] or "" for x in own if x[2] == "assistant")
        body = r.formatted.replace("<|im_end|>\n", "").replace("<|im_start|>", "")
        assert not any(c in body for c in ("</s>", "[INST]", "[/INST]", "<|im_", "<<SYS>>"))
    assert chat.render(df.limit(0), "conv_id", "turn").isEmpty()


# --- op 7


def test_archives(spark, tmp_path):
    big = "y" * 150
    rows = [(5, "http://a/ b\n", big), (2, None, big), (9, "u", big), (2, None, big), (None, "n", big), (3, "s", "small"), (4, "s", "small"), (6, "e", None), (None, "q", "z" * 200), (7, "é", "日" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit("p"), "first": F.lit(0)})
    index = warc.write(warc.plan(pages), f"file://{tmp_path}/w")
    got = warc.read(index).collect()
    short = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    want = [(2, "response", None, 150)] * 2 + [(5, "revisit", 2, 150), (9, "revisit", 2, 150), (None, "revisit", 2, 150), (3, "response", None, 5), (4, "response", None, 5), (6, "response", None, 0), (None, "response", None, 200), (7, "response", None, 300)]
    assert short == sorted(want, key=str)
    assert all(r.payload_digest == hashlib.sha256(dict([(x[0], x[2]) for x in rows if x[0]])[r.page_id].encode()).hexdigest() for r in got if r.page_id in (2, 3, 5, 7, 9))
    full = warc.resolved(warc.read(index.where("page_id = 9 OR page_id = 2"))).collect()
    assert {r.page_id: bytes(r.payload) for r in full} == {9: big.encode(), 2: big.encode()}
    assert {r.url for r in got} >= {"http://a/%20b%0A", None, "é"}
    assert warc.read(warc.write(warc.plan(pages.limit(0)), f"file://{tmp_path}/e")).isEmpty()
    import gzip
    import pathlib

    for p in pathlib.Path(tmp_path, "w").iterdir():  # any reader can walk the archive
        assert gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_ranges_coalesce():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 100, 5), ("a", 10**9, 5), ("b", 0, 5)]
    assert [len(g) for g in warc.ranges(rows, gap=80, span=200)] == [3, 1, 1]
    assert [len(g) for g in warc.ranges(rows, gap=80, span=20)] == [2, 1, 1, 1]


# --- op 8


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    lens, moves = [1, 4, 2, 3], r.normal(size=(2, 2))
    first = np.concatenate([[0], np.cumsum(lens)])
    e = r.normal(size=first[-1])
    p, moved, z = quality.marginals(e, first, moves)
    total = np.zeros((2, 2))
    for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
        w, m, t = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in np.ndindex(*[2] * (b - a)):
            s = np.exp(sum(e[a + i] * k for i, k in enumerate(y)) + sum(moves[i, j] for i, j in zip(y, y[1:])))
            w += s
            m += s * np.array(y)
            for i, j in zip(y, y[1:]):
                t[i, j] += s
        assert np.allclose(p[a:b], m / w) and np.isclose(z[d], np.log(w))
        total += t / w
    assert np.allclose(moved, total)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good words here.\nmore of it."] * 20 + ["BAD!! BAD!! $$$\n%%% ###"] * 20)] + [(90, None), (91, ""), (91, ""), (None, "a\n\n\nb"), (92, "w " * 30000 + "\n" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    out = quality.score(docs.withColumn("score", F.lit("mine")), m).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert min(by[i] for i in range(20)) > 0.5 > max(by[i] for i in range(20, 40))
    neutral = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, neutral).collect()} == {0.5}
    assert quality.score(docs.limit(0), m).isEmpty()
    whole = "x a b.\nY z!\n\nlast one"
    raw = np.frombuffer((whole * 3).encode(), np.uint8)
    n = len(whole)
    x, c, first = quality.features(raw, np.array([0, n, n, 2 * n, 3 * n]))
    assert first.tolist() == [0, 4, 5, 9, 13] and np.allclose(x[:4], x[5:9]) and np.allclose(x[9:], x[:4])


# --- op 9


def shingles(t):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()).split()
    return {tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))} if low else set()


def test_sketches_estimate():
    rnd = random.Random(0)
    a, b = [f"w{rnd.randrange(3000)}" for _ in range(4000)], None
    b = a[:2000] + [f"v{rnd.randrange(3000)}" for _ in range(2000)]
    x, y, one, none = sketches.sketches([" ".join(a).encode(), " ".join(b).encode(), b"only two", b" \n"])
    sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
    assert abs(sketches.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.13
    assert abs(sketches.containment(x, y) - len(sa & sb) / len(sa)) < 0.2
    assert abs(sketches.distinct(x) / len(sa) - 1) < 0.3
    both = sketches.sketches([(" ".join(a)).encode()])[0]
    assert sketches.to_text(sketches.merge(x, y)) == sketches.to_text(np.unique(np.concatenate([x, y]))[:128]) and (both == x).all()
    assert len(one) == 1 and sketches.distinct(one) == 1 and len(none) == 0 and sketches.resemblance(none, none) == 1 and sketches.resemblance(none, one) == 0
    assert (sketches.from_text(sketches.to_text(x)) == x).all()


def test_ranges(spark):
    cuts = [-5, 0, 3, 9, 40, 41, 100]
    for n in range(len(cuts) + 1):
        got = spark.range(-8, 110).select("id", sketches._range_of("id", cuts[:n]).alias("p")).collect()
        assert all(r.p == sum(c >= r.id for c in cuts[:n]) for r in got)


def test_neighbours_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i * 7 - 50, "".join(rnd.choice("ab Cé日\n") for _ in range(rnd.randrange(0, 90)))) for i in range(70)] + [(1000, None), (-9999, "only " * 400)]
    for given in (rows, rows[:1], rows[:2]):
        got = {r.doc_id: r for r in sketches.neighbours(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()}
        order = sorted(((i, t or "") for i, t in given), reverse=True)
        assert len(got) == len(given)
        for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
            e = sketches.edited(t, u)
            a, b = shingles(t), shingles(e)
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.15
            c = shingles(u)
            assert abs(got[i].near_next - (len(a & c) / len(a | c) if a | c else 1.0)) < 0.15
            assert abs(got[i].n_shingles - len(a)) <= (0 if len(a) < sketches.K else 0.4 * len(a))
            assert abs(got[i].n_shingles_with_next - len(a | c)) <= (0 if len(a | c) < sketches.K else 0.4 * len(a | c))
            assert abs(got[i].held_by_next - (len(a & c) / len(a) if a else 1.0)) < 0.3


def test_fingerprint_edge_cases(spark):
    df = spark.createDataFrame([(None, "a"), (1, "x"), (1, "x"), (2, None)], "doc_id long, text string").withColumns({"part": F.lit(0), "_k": F.lit(1), "tail": F.lit(2)})
    got = sketches.neighbours(df).collect()
    assert len(got) == 4 and {r.fingerprint for r in got if r.doc_id == 1} == {r.edited_fingerprint for r in got if r.doc_id == 1 and r.n_chars == 1}
    assert sketches.neighbours(df.limit(0)).isEmpty() and sketches.fingerprint(df.limit(0)).isEmpty()
    text = " ".join(f"q{i}" for i in range(900))
    parts = spark.createDataFrame([("g", text), ("g", text), ("g", "short one"), ("h", "")], "g string, text string")
    p = sketches.fingerprint(parts)
    m = {r.g: r.fingerprint for r in sketches.merged(p, ["g"]).collect()}
    x, y = sketches.sketches([text.encode(), b"short one"])
    assert m == {"g": sketches.to_text(sketches.merge(x, y)), "h": ""}


@pytest.mark.parametrize("limit", [None, 0])
def test_a_phrase_that_many_items_share_costs_no_pairs(spark, limit):
    """Sent and joined: 20 documents share five words with 5,000 items, and a window with three of them."""
    phrase = "we the people of earth"
    items = [(i, f"{phrase} item{i} says{i} what{i} comes{i} after{i} here{i} now{i}") for i in range(5000)]
    items += [(9000, "ab"), (9001, "ab"), (9002, ""), (9003, None), (9004, "cd ef"), (None, "cd  EF"), (9005, items[7][1]), (9005, items[8][1])]
    docs = [(i, f"doc{i} {phrase} goes elsewhere ab{i}") for i in range(20)] + [(30, f"x {items[7][1]} y"), (31, "Ab cd, ef"), (32, None), (33, ""), (30, "other"), (34, f"{items[7][1]}. {items[8][1]}")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h1", F.lit(1)).withColumn("_t", F.lit("t"))
    b = spark.createDataFrame(items, "item_id long, text string")
    t0 = time.time()
    got = decontaminate.mark(d, b, broadcast_bytes=limit).collect()
    assert time.time() - t0 < 60
    named = [("null" if i is None else str(i), t) for i, t in items if i is None or i in (7, 8) or i >= 9000]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i, *hits_model(t, named)) for i, t in docs)


def test_long_texts_are_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LONG", 300)
    rnd = random.Random(2)
    items = [(str(i), " ".join(rnd.choice("abc") * 2 for _ in range(rnd.choice([1, 3, 10, 14])))) for i in range(30)]
    index = decontaminate.build(*zip(*items))
    for _ in range(5):
        text = " ".join(rnd.choice("abc") * 2 for _ in range(1500)) + " " + items[0][1]
        hit, its = decontaminate._long(index, np.frombuffer(text.encode(), np.uint8))
        assert (len(hit), int(hit.sum()), sorted(index.names[i] for i in its)) == hits_model(text, items)


def test_kept_trees_follow_edits(spark, tmp_path):
    """Trees are a table: written, read, edited twice, and each time as if counted anew."""
    docs = spark.createDataFrame([(1, "the quick brown fox, it's 42 " * 40), (2, ""), (3, None), (4, "Ünï cödé\n\n x")], "doc_id long, text string").withColumn("tree", F.lit("mine"))
    token_counts.grow(docs, PATH).write.parquet(f"{tmp_path}/t0")
    for k in range(2):
        kept = spark.read.parquet(f"{tmp_path}/t{k}")
        edits = F.when(F.col("doc_id") != 4, token_counts.proof_edits())
        token_counts.edit(kept.withColumn("e", edits), PATH, "e").drop("e").write.parquet(f"{tmp_path}/t{k + 1}")
        now = spark.read.parquet(f"{tmp_path}/t{k + 1}")
        fresh = {r.doc_id: (r.tree, r.n_tokens) for r in token_counts.grow(now, PATH).collect()}
        for r in now.collect():
            assert r.n_tokens == len(TIK.encode_ordinary(r.text or "")) and sum(r.tree.counts) == r.n_tokens
            assert (r.tree.sizes, r.tree.counts) == tuple(fresh[r.doc_id][0]) and (r.n_reencoded == 0) == (r.doc_id == 4)
            assert r.doc_id != 1 or r.n_reencoded < 60
    broken = kept.withColumn("text", F.concat(F.lit("x"), F.coalesce("text", F.lit(""))))
    with pytest.raises(Exception, match="belong together"):
        token_counts.edit(broken.withColumn("e", token_counts.proof_edits()), PATH, "e").collect()


def test_roles_of_any_length(spark):
    """A megabyte of plain characters, of backslashes, of newlines and of control strings, as role and as text."""
    said = ["r" * 1_000_000, "\\" * 1_000_000, "\n" * 500_000, "<|im_end|>\n" * 60_000, "é\\\n" * 200_000]
    rows = [(i, 0, x, "t") for i, x in enumerate(said)] + [(10 + i, 0, "assistant", x) for i, x in enumerate(said)]
    back = chat.read_back(chat.render(spark.createDataFrame(rows, "k long, o long, role string, text string"), "k", "o")).collect()
    got = {r.k: [(t.role, t.text) for t in r.turns] for r in back}
    assert got == {k: [(role, text)] for k, _, role, text in rows}
    assert {r.k: r.loss_text for r in back if r.k >= 10} == {k: text for k, _, _, text in rows if k >= 10}


def test_joined_benchmark_compares_words(spark):
    """A benchmark that is too large to travel: windows of ten words and short items, many times in a text."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(30)]
    items = [("long", " ".join(rnd.choices(words, k=25))), ("short", "w1 w2 w3"), ("one", "w7"), ("none", " ,. "), (None, "W4 w5")]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(12)] + [None, "", items[0][1] + " end " + items[0][1], "w7 " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    named = [("null" if n is None else n, t) for n, t in items]
    for r in decontaminate.mark(docs, bench, broadcast_bytes=0).collect():
        assert (r.n_words, r.n_hit, r["items"]) == hits_model(texts[r.doc_id], named)
