"""Very long texts in parts, and bytes that are no UTF-8: the same results, defined ones."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from trailhead.llm import anchors, bpe, decontaminate, hashes, near_copies, quality, runtime, simhash, sketches, substrings, suffix_arrays, token_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def some_text(rnd, n):
    return "".join(rnd.choice(["a", "bb", "Ünï", "42", "don't", " ", "  ", "\n", "!?", " the", " it's", "\t", " 中文", " x"]) for _ in range(n))


def as_bytes(t):
    return np.frombuffer(t.encode(), np.uint8)


@pytest.mark.parametrize("table, overlap", [(hashes.NOT_SPACE, 4), (hashes.NOT_SPACE, 19), (hashes.ALNUM, 9), (hashes.NOT_SPACE, 0)])
def test_parts_hold_every_word_once_beside_the_overlap(table, overlap):
    rnd = random.Random(overlap)
    for t in [some_text(rnd, 900), "x" * 500, " " * 300, "ab " * 200, " " + "y" * 200 + " z"]:
        d = as_bytes(t)
        words = lambda x: [bytes(x[a:b]) for a, b in zip(*hashes.word_spans(x, np.array([0, len(x)]), table)[:2])]
        got = []
        for a, b, repeats in runtime.parts(d, table, overlap, 50):
            w = words(d[a:b])
            assert w[:repeats] == (got[-repeats:] if repeats else []) and (repeats == overlap or repeats == len(got) or not a)
            got += w[repeats:]
        assert got == words(d)


def test_pretokens_of_long_texts(monkeypatch):
    rnd = random.Random(1)
    raw = open(PATH, "rb").read()
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    enc = bpe.Encoder(raw)
    monkeypatch.setattr(bpe, "LONG", 64)
    monkeypatch.setattr(bpe, "_STEP", 16)
    monkeypatch.setattr(bpe, "_AT_ONCE", 7)
    for _ in range(30):
        t = some_text(rnd, 400)
        d = as_bytes(t)
        bounds, first = bpe.boundaries(d, np.array([0, len(d)]))
        assert first.tolist() == [0, len(bounds) - 1]
        assert enc.ids(d.tobytes(), bounds)[1].tolist() == tik.encode_ordinary(t)


def test_sketches_and_shingle_sets_of_long_texts(monkeypatch):
    rnd = random.Random(2)
    for t in [some_text(rnd, 2000), "one " * 300, "x" * 900, "a " + "b" * 900, ""]:
        want, whole = sketches.sketches([t.encode()], 16), near_copies.shingle_sets(as_bytes(t), np.array([0, len(t.encode())]), 5)[0]
        monkeypatch.setattr(sketches, "LONG", 70)
        assert [x.tolist() for x in sketches.sketches([t.encode()], 16)] == [x.tolist() for x in want]
        monkeypatch.setattr(near_copies, "LONG", 70)
        assert near_copies._long_set(as_bytes(t), 5).tolist() == whole.tolist()
        monkeypatch.undo()


@pytest.mark.parametrize("scheme", [anchors.Scheme(True, 20, 5), anchors.Scheme(False, 30, 8)])
def test_segments_of_long_texts_have_the_same_windows(monkeypatch, scheme):
    rnd = random.Random(3)
    texts = [some_text(rnd, 1500), "ab " * 400, "short", ""]

    def windows():
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["_k", "_t"])
        seg = np.concatenate(list(anchors._segment_batches(scheme, np.zeros(0, np.uint64), [batch])))
        return sorted((int(x["k"]), int(x["p"]) + j, int(x["a"])) for x in seg for j in range(x["n"]))

    whole = windows()
    monkeypatch.setattr(anchors, "LONG", 200)
    monkeypatch.setattr(anchors, "_BYTES", 100)
    assert windows() == whole and whole


def test_removed_runs_and_the_rest():
    rnd = random.Random(4)
    for _ in range(200):
        n, w = rnd.randrange(1, 60), rnd.randrange(1, 8)
        runs = [(rnd.randrange(n), rnd.randrange(1, 5)) for _ in range(rnd.randrange(6))]
        mask = np.zeros(n, bool)
        for p, r in runs:
            mask[p : p + r - 1 + w] = True
        spans = anchors.removed(np.array([anchors.pack(p, r) for p, r in runs], np.int64), w, n)
        again = np.zeros(n, bool)
        for a, b in spans:
            again[a:b] = True
        assert (again == mask).all() and (len(spans) < 2 or (spans[1:, 0] > spans[:-1, 1]).all())
        assert sum(b - a for a, b in anchors.rest(spans, n)) == n - mask.sum()


def test_bytes_that_are_no_utf8(spark):
    """Each operator runs, with the result of the text that has U+FFFD in their place."""
    fffd = spark.createDataFrame([(1, "good words here and there again"), (2, "bad �� words � here"), (3, "bad �� words � here"), (4, None)], "doc_id long, text string")
    rows = spark.createDataFrame([(1, bytearray(b"good words here and there again")), (2, bytearray(b"bad \xff\xfe words \xc3 here")), (3, bytearray("bad �� words � here".encode())), (4, None)], "doc_id long, raw binary")
    broken = rows.select("doc_id", F.col("raw").cast("string").alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "words here")], "item_id long, text string")
    model = quality.train(broken, labels)
    edits = token_counts.proof_edits(runtime.text("text"))
    for run in (
        lambda d: simhash.classes(d), lambda d: simhash.similar(d), lambda d: bpe.encode(d, PATH).drop("text"), lambda d: bpe.decode(bpe.encode(d, PATH), PATH).select("doc_id", "decoded"),
        lambda d: substrings.dedup(d, 3).select("doc_id", "kept", "n_removed"), lambda d: suffix_arrays.dedup(d, 9).select("doc_id", "kept", "n_removed"),
        lambda d: token_counts.count(d.withColumn("e", edits), PATH, edits_col="e").drop("text", "e"), lambda d: quality.score(d, model).drop("text"),
        lambda d: sketches.fingerprint(d).drop("text"), lambda d: sketches.neighbours(d), lambda d: decontaminate.mark(d, bench).select("doc_id", "n_words", "n_hit", "items"),
    ):
        got, want = ({r.doc_id: r for r in run(d).collect()} for d in (broken, fffd))
        assert got == want and len(got) == 4


def test_line_features_of_long_texts(monkeypatch):
    rnd = random.Random(9)
    texts = [some_text(rnd, 1500), "same same same " * 100, "x" * 700, "\n" * 400, "a b\n" * 200, "a\n \n\n" * 90 + "b b", " \n" + "word word  " * 90 + "\n", "one\n" + "w " * 300 + "\n\nlast"]
    for t in texts:
        d = as_bytes(t)
        off = np.array([0, len(d)])
        want = quality.features(d, off)
        for size in (40, 64, 111):
            monkeypatch.setattr(quality, "LONG", size)
            for x, y in zip(want, quality.features(d, off)):
                assert np.allclose(x, y) and x.shape == y.shape
            monkeypatch.undo()


def test_training_takes_long_documents_too(spark):
    rows = [(i, "\n".join(("good fine words here, and more." if i % 2 else "!!! ### $$$ zz zz zz") for _ in range(500))) for i in range(40)]
    docs = spark.createDataFrame(rows * 2 + [(41, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_docs=20, sample_lines=7)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(40))


def random_model(rng):
    width = 3 * quality.OWN + 3
    return quality.Model(rng.normal(size=width), rng.random(width) + 0.5, rng.normal(size=width) / 5, rng.normal(size=(2, 2)), (0.3, 2.0))


def test_chunked_marginals_are_the_plain_ones():
    rng = np.random.default_rng(4)
    for lens in ([1], [300, 1, 7, 64, 65, 3], [5000], [2, 900, 2]):
        first = np.concatenate([[0], np.cumsum(lens)])
        e, moves = rng.normal(size=first[-1]) * 3, rng.normal(size=(2, 2))
        want = quality.marginals(e, first, moves)[0]
        for chunk in (1, 2, 7, 64, 10000):
            assert np.allclose(quality.good(e, first, moves, chunk), want)


def test_quality_in_blocks_is_that_of_all_features(monkeypatch):
    rng, rnd = np.random.default_rng(5), random.Random(8)
    texts = [some_text(rnd, 900), "", "\n" * 400, "a b\n" * 200, "one", "a\n \n\n" * 90 + "b b", "x" * 700, "\n", "tail\n\n"]
    model = random_model(rng)
    data, off = np.concatenate([as_bytes(t) for t in texts]), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x, chars, first = quality.features(data, off)
    want = quality.quality(quality.marginals(model.emissions(x), first, model.moves)[0], chars, first)
    assert np.allclose(quality.texts_quality(model, data, off), want)
    for size in (40, 64, 111):
        monkeypatch.setattr(quality, "LONG", size)
        for t, w in zip(texts, want):
            assert np.allclose(quality.texts_quality(model, as_bytes(t), np.array([0, len(t.encode())])), w)
        monkeypatch.undo()


def test_training_lines_come_from_the_whole_text(monkeypatch):
    lines = [f"line {i} " + "w " * (i % 9) for i in range(1000)]
    data = as_bytes("\n".join(lines))
    x, chars, _ = quality.features(data, np.array([0, len(data)]))
    monkeypatch.setattr(quality, "LONG", 500)
    got, c, sizes = quality.sampled(data, 200, 25, 12345)
    assert sizes.tolist() == [25] * 8
    cuts = [1000 * i // 8 for i in range(9)]
    want = np.concatenate([np.arange(25) + p + 12345 % (q - p - 24) for p, q in zip(cuts, cuts[1:])])
    assert np.allclose(got, x[want]) and np.allclose(c, chars[want])
    got, c, sizes = quality.sampled(data, 1000, 25, 1)
    assert sizes.tolist() == [1000] and np.allclose(got, x) and np.allclose(c, chars)


def test_a_text_of_very_many_lines_is_scored():
    """20 MB of newlines, and 20 MB of one line: bounded memory and time."""
    import resource
    import subprocess
    import sys

    code = """
import time, numpy as np
from trailhead.llm import quality
rng = np.random.default_rng(1)
width = 3 * quality.OWN + 3
m = quality.Model(np.zeros(width), np.ones(width), rng.normal(size=width) / 5, rng.normal(size=(2, 2)))
for text in (b"\\n" * (20 << 20), b"word " * (4 << 20), b"x" * (20 << 20)):
    t = time.time()
    q = quality.texts_quality(m, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert 0 <= q[0] <= 1 and time.time() - t < 60, (q, time.time() - t)
"""
    limit = lambda: resource.setrlimit(resource.RLIMIT_AS, (4 << 30, 4 << 30))  # noqa: E731  address space, of which under half is used
    subprocess.run([sys.executable, "-c", code], check=True, preexec_fn=limit, env={**__import__("os").environ, "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"})
