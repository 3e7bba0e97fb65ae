"""What a task holds at once does not grow with the batch, the questions or the walks."""

import random

import numpy as np
import pyarrow as pa

from trailhead import session
from trailhead.functions import text
from trailhead.operators import graph, vectors


def test_a_kernel_gets_a_piece_of_a_batch():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30, "", "c" * 5])], ["t"])
    assert [p.column("t").to_pylist() for p in text.pieces(b, "t", 16)] == [["a" * 10, None], ["b" * 30], ["", "c" * 5]]
    assert [p.num_rows for p in text.pieces(b, "t", 1 << 20)] == [5] and not list(text.pieces(b.slice(0, 0), "t"))


def test_fingerprints_do_not_depend_on_pieces(spark, monkeypatch):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 40)))) for i in range(50)] + [(50, None), (51, "x " * 70_000)]
    df = spark.createDataFrame(docs, "id int, t string")
    got = {r.id: r.simhash for r in text.simhash_of_text(df, "t").collect()}
    assert got == {i: text.simhash_py([(w, 1) for w in (t or "").split()]) for i, t in docs}


def test_best_of_tiles_equals_a_sort():
    """Ties by id, rounds of tiles in any order, queries of zeros, and many vectors that are alike."""
    rnd = np.random.default_rng(1)
    m = np.concatenate([rnd.integers(-2, 3, (300, 4)), np.ones((200, 4))]).astype(float)
    q = np.concatenate([rnd.integers(-2, 3, (20, 4)), np.zeros((2, 4)), np.ones((3, 4))]).astype(float)
    ids = [f"v{i:03d}" for i in rnd.permutation(len(m))]
    best = vectors.Best(len(q), 5)
    for at in range(0, len(m), 37):
        for lo in range(0, len(q), 8):
            best.meet(lo, q[lo : lo + 8] @ m[at : at + 37].T, pa.array(ids[at : at + 37]))
    got: dict = {}
    for i, s, x in zip(*best.rows()):
        got.setdefault(int(i), []).append((-float(s), x.as_py()))
    assert got == {i: sorted((-float(s), x) for s, x in zip(q[i] @ m.T, ids))[:5] for i in range(len(q))}


def test_walks_come_to_python_few_at_a_time(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with session.batches(spark, graph.BATCH_WALKS):
        sizes = spark.range(1000).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) <= graph.BATCH_WALKS and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_stored_table_is_cut_by_as_many_tasks_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    """The first write, of which a key has several rows, a large batch over it, and what is read of both."""
    from trailhead.operators import layered

    monkeypatch.setattr(layered, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(layered, "BROADCAST_ROWS", 10)
    st = layered.Store(spark, str(tmp_path / "s"))
    rows = lambda some, w, gone=False: [(f"a{i % 7}", f"t{i}", "X", float(w), gone) for i in some]
    kind = "source_id string, target_id string, type string, weight double, _gone boolean"
    st.upsert({"edges": spark.createDataFrame(rows(range(3000), 1) + rows(range(0, 3000, 2), 2) + rows(range(5), 9, True), kind).coalesce(1)})
    base = [p for p, *_ in st.layers("edges")["base"].values()]
    sizes = [r["count"] for r in spark.read.parquet(*base).selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1000 and not any(n.startswith("changes") for n in st.files.names(f"{st.folder}/edges"))
    want = {f"t{i}": 2.0 - i % 2 for i in range(5, 3000)}
    assert {r.target_id: r.weight for r in st.read("edges").collect()} == want
    st.upsert({"edges": spark.createDataFrame(rows(range(100, 500), 5) + rows(range(500, 700), 1, True) + rows(range(4000, 4100), 3), kind)}, rows=700)
    assert len(st.layers("edges")["deltas"]) == 1
    want = {t: w for t, w in want.items() if not 500 <= int(t[1:]) < 700} | {f"t{i}": 5.0 for i in range(100, 500)} | {f"t{i}": 3.0 for i in range(4000, 4100)}
    assert {r.target_id: r.weight for r in st.read("edges").collect()} == want
    st.upsert({"edges": spark.createDataFrame(rows(range(100, 2500), 6), kind)}, rows=2400)  # folded
    assert not st.layers("edges")["deltas"]
    assert {r.target_id: r.weight for r in st.read("edges").collect()} == want | {f"t{i}": 6.0 for i in range(100, 2500)}


def test_a_call_matches_many_shapes_with_one_read_and_one_write(monkeypatch):
    """Against a model, over batches with renames and deletes, however the state is cut."""
    import pandas as pd

    from trailhead.streaming import matching

    class Parts:
        rows, reads, writes = [], 0, 0

        def get(self):
            self.reads += 1
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.writes = list(rows), self.writes + 1

        def appendList(self, rows):
            self.rows, self.writes = self.rows + list(rows), self.writes + 1

        def clear(self):
            self.put([])

    rnd = random.Random(8)
    for entries in (matching.PART_ENTRIES, 7):
        monkeypatch.setattr(matching, "PART_ENTRIES", entries)
        shapes, parts, model = matching._Shapes(), Parts(), {}
        shapes.parts = parts
        for batch in range(30):
            rows = [(batch * 100 + i, f"f{rnd.randrange(6)}", rnd.choice("UUD"), None if (n := rnd.randrange(20)) == 0 else str(2**62 + n)) for i in range(60)]
            rows = [(*r, f"{r[1]}-{r[3]}"[::-1]) for r in rows]
            got = pd.concat(shapes.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["seq", "file_path", "op", "shape", "own_id"])]), None))
            want = []
            for seq, path, op, shape, own in rows:
                held = model.setdefault(shape, {})
                if op == "D":
                    held.pop(path, None)
                    continue
                known = held.get(path)
                other = min(held.values()) if known is None and held else None
                held[path] = known or own
                want.append((seq, path, None if shape is None else int(shape), held[path], known is None, other if other != held[path] else None))
            assert [tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in got.astype(object).itertuples(index=False)] == want
            assert parts.reads == batch + 1 and parts.writes <= batch + 1 and len(parts.rows) <= 8 + 120 // entries + 120 // entries + 2


def test_answers_lie_in_files_of_a_stated_length(spark, monkeypatch):
    """Many files a part give the rows of one."""
    from trailhead.plans import code_queries

    sf = "/root/testdata/sf0.001"
    one = sorted(map(tuple, code_queries.q_chunk_stream(spark, sf).collect()))
    monkeypatch.setattr(code_queries, "CHUNK_LINES", 100)
    sizes, run = [], code_queries.chunks.run

    def counted(spark, source, *rest):
        sizes.extend(r.n for r in spark.read.text(source).selectExpr("_metadata.file_path AS f").groupBy("f").count().selectExpr("count AS n").collect())
        run(spark, source, *rest)

    monkeypatch.setattr(code_queries.chunks, "run", counted)
    assert sorted(map(tuple, code_queries.q_chunk_stream(spark, sf).collect())) == one and len(sizes) > 6
