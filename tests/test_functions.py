import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailhead.functions import hashing, text, wire

#: Golden hashes.
GOLDEN = {"": 0x14650FB0739D0383, "a": 0x44BD8AD473CD9906, "login": 0xD6CCBF76C7DAAD70, "a.cpp": 0x41F47CA2F00616C9, "/repo": 0xD29C271D9BBBCEA0}
BEFORE = [("function_definition", 1), ("(", 1), (")", 1), ("{", 1), ("call_expression", 2), ("(", 1), (")", 1), (";", 1), ("}", 1)]
OTHER = [("function_definition", 1), ("(", 1), (")", 1), ("{", 1), ("if_statement", 2), ("(", 1), (")", 1), ("{", 1), ("call_expression", 2), ("(", 1), (")", 1), (";", 1), ("}", 1), ("}", 1)]


def unsigned(x):
    return x % 2**64


def test_hash_goldens(spark):
    rows = spark.createDataFrame([(k,) for k in [*GOLDEN, "naïve 日本"]], "k string").select("k", hashing.fnv1a(F.col("k")).alias("h")).collect()
    for r in rows:
        assert unsigned(r.h) == GOLDEN.get(r.k, hashing.fnv_py(r.k.encode()))
    got = spark.range(1).select(hashing.namespace(F.lit("/repo"), "x").alias("s")).first().s
    assert got == "/tmp/x-d29c271d9bbbcea0.sock"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6))
def test_word_kernel_equals_scalar_hash(texts):
    parts = [t.encode("utf-8", "ignore") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = hashing.lower(np.frombuffer(b"".join(parts), np.uint8))
    row, s, e = hashing.words(data, off) if texts else ([], [], [])
    want = []
    for i, p in enumerate(parts):
        word = b""
        for b in p.lower() + b" ":
            c = bytes([b])
            if c.isalnum() and b < 128:
                word += c
            elif word:
                want.append((i, hashing.fnv_py(word)))
                word = b""
    if texts:
        assert list(zip(row.tolist(), hashing.fnv_words(data, s, e).tolist())) == want


def test_embedding_goldens(spark):
    q = [("How does the auth payload move through the system?",), ("naïve user_id userId",), ("the is in",), (None,), ("",)]
    rows = text.embed(text.embed_sparse(spark.createDataFrame(q, "t string").coalesce(1), "t"), "t", "v").collect()
    assert [(x.bucket, x.v) for x in rows[0].embedding] == [(138, 1), (144, 1), (170, -1), (310, 1), (339, -1), (349, 1)]
    assert [(x.bucket, x.v) for x in rows[1].embedding] == [(78, -1), (96, -1), (221, 1), (222, -1), (290, -1)]
    assert math.isclose(rows[0].v[138], 1 / math.sqrt(6), rel_tol=1e-6) and len(rows[0].v) == 384
    assert all(not r.embedding and set(r.v) == {0.0} for r in rows[2:])
    alone = text.embed(spark.createDataFrame([("the is in",)], "t string"), "t").first()  # no word at all in a batch
    assert set(alone.vector) == {0.0}


def test_simhash_goldens_and_invariance(spark):
    assert unsigned(text.simhash_py(BEFORE)) == 0x44BD42D473CD1B98
    assert unsigned(text.simhash_py(OTHER)) == 0x44BD42D473CD1A9A
    assert text.simhash_py(BEFORE[::-1]) == text.simhash_py(BEFORE)
    rows = [(i, [{"text": t, "weight": w} for t, w in x]) for i, x in enumerate((BEFORE, OTHER, []))]
    got = spark.createDataFrame(rows, "i int, t array<struct<text:string,weight:int>>").select("i", text.simhash_tokens(F.col("t")).alias("h")).orderBy("i").collect()
    assert [unsigned(r.h) for r in got] == [0x44BD42D473CD1B98, 0x44BD42D473CD1A9A, 0]
    d = spark.createDataFrame([(got[0].h, got[1].h), (-1, 0)], "a long, b long").select(text.hamming(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in d] == [2, 64]
    one = text.simhash_of_text(spark.createDataFrame([("login",), ("",), (None,)], "t string"), "t").collect()
    assert [unsigned(r.simhash) for r in one] == [GOLDEN["login"], 0, 0]


def test_wire_round_trip_and_defaults(spark):
    node = {"nodeId": "n1", "filePath": "a\\b", "codeSnippet": 'x "y"\nz', "uncertain": True}
    df = spark.createDataFrame([("t", "q\n", False, [node])], "traceId string, userQuery string, requireCitations boolean, context array<struct<nodeId:string,filePath:string,codeSnippet:string,uncertain:boolean>>")
    back = df.select(wire.decode_request(wire.encode_request(F.struct("*"))).alias("r")).first().r
    assert (back.traceId, back.userQuery, back.requireCitations) == ("t", "q\n", False) and back.context[0].asDict() == node
    raw = spark.createDataFrame([("{}",), ('{"context":[{"nodeId":"a"},{"nodeId":""},{"nodeId":"b"}]}',), ("broken",)], "j string").select(wire.decode_request(F.col("j")).alias("r"), wire.decode_chunk(F.col("j")).alias("c")).collect()
    assert raw[0].r.requireCitations and raw[0].r.context == [] and raw[0].c.asDict() == {"traceId": "", "textDelta": "", "done": False, "unverifiedCitation": False}
    assert [c.nodeId for c in raw[1].r.context] == ["a"] and raw[2].r.traceId == ""
    esc = spark.range(1).select(wire.escape(F.lit('a"b\\c\n')).alias("e"), wire.model_answer(F.lit('{"message":{"content":"x\\ny"}}')).alias("m"), wire.bool_field(F.lit('{"a":true}'), "a", False).alias("b")).first()
    assert esc.e == 'a\\"b\\\\c\\n' and esc.m == "x\ny" and esc.b


def test_citations_and_slices(spark):
    r = spark.range(1).select(wire.citations(F.lit("x [node:a] y [node:b] [node:a] [node:] [node:z")).alias("c"), wire.id_array(F.lit('["a","b"]')).alias("i"), wire.id_array(F.lit("no")).alias("n")).first()
    assert (r.c, r.i, r.n) == (["a", "b", ""], ["a", "b"], [])
    s = spark.createDataFrame([("héllo".encode(), -5, 3), (b"abc", 2, 99), (b"abc", 5, 9), (b"abc", 2, 1)], "b binary, s long, e long").select(wire.byte_slice(F.col("b"), F.col("s"), F.col("e")).alias("x")).collect()
    assert [bytes(x.x) for x in s] == ["hé".encode(), b"c", b"", b""]
