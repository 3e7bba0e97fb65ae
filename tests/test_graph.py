import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailhead.operators import alias, graph, vectors

DAG = [("A", "B", "CALLS", 1.0), ("A", "C", "CALLS", 1.0), ("B", "C", "CALLS", 1.0)]
CYCLE = [("A", "B", "X", 1.0), ("A", "C", "X", 1.0), ("B", "B", "X", 1.0), ("B", "C", "X", 1.0), ("C", "A", "X", 1.0)]
E = "source_id string, target_id string, type string, weight double"


def push(spark, edges, seeds, *args, **kw):
    rows = graph.local_push(spark.createDataFrame(edges, E), spark.createDataFrame([(s,) for s in seeds], "seed string"), *args, **kw).collect()
    return {(r.seed, r.id): r.score for r in rows}


def model(edges, seed, alpha, eps, budget):
    """Everything known from the start."""
    out = {}
    for s, t, k, w in sorted(edges, key=lambda e: (e[0], e[1], e[2])):
        out.setdefault(s, []).append((t, w))
    nodes = {seed} | {t for _, t, _, _ in edges} | set(out)
    known = {u: [(t, w, len(out.get(t, []))) for t, w in out.get(u, [])] for u in nodes}
    state = graph.start(seed)
    assert graph.advance(state, known, alpha, eps, budget)
    return state["p"]


def test_push_goldens(spark):
    assert push(spark, DAG, ["A"], 0.5, 1e-4) == {("A", "A"): 0.5, ("A", "B"): 0.125, ("A", "C"): 0.1875}
    got = push(spark, DAG, ["A", "Z", None], 0.1, 1e-5)
    assert got[("A", "C")] == pytest.approx(0.0855) and got[("A", "B")] == pytest.approx(0.045)
    assert got[("Z", "Z")] == pytest.approx(0.1)


def test_push_equals_model_on_random_graphs(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", t, float(rnd.randrange(1, 5))) for t in "XY" for _ in range(30)]
    edges = list({e[:3]: e for e in edges}.values())
    for alpha, eps, budget in ((0.5, 1e-4, 40), (0.1, 1e-5, 7)):
        for small in (None, 0):  # sent whole, and asked in rounds
            got = push(spark, edges, ["n0", "n3"], alpha, eps, budget, small=small)
            for s in ("n0", "n3"):
                want = model(edges, s, alpha, eps, budget)
                assert {i: v for (x, i), v in got.items() if x == s} == pytest.approx(want)
                assert sum(want.values()) <= 1 + 1e-9


def test_cycle_and_wide_hub(spark):
    p = model(CYCLE, "A", 0.5, 1e-4, 40)
    assert p["A"] == pytest.approx(0.599939, abs=2e-4)
    hub = [("h", f"t{i:03}", "X", 1.0) for i in range(100)]
    assert len(push(spark, hub, ["h"], 0.1, 1e-5)) == 40  # the budget, in edge order
    assert ("h", "t038") in push(spark, hub, ["h"], 0.1, 1e-5) and ("h", "t039") not in push(spark, hub, ["h"], 0.1, 1e-5)


def test_dual_horizon_and_fusion(spark):
    got = graph.dual_horizon(spark.createDataFrame(DAG, E), spark.createDataFrame([("A",)], "seed string")).orderBy("rank").collect()
    assert [(r.id, round(r.score, 8)) for r in got] == [("A", 0.03278689), ("C", 0.03225806), ("B", 0.03174603)]
    a = spark.createDataFrame([("s", "x", 1), ("s", "y", 2)], "seed string, id string, rank int")
    b = spark.createDataFrame([("s", "y", 1), ("s", "x", 2)], "seed string, id string, rank int")
    one, two = ({r.id: r.score for r in graph.fuse(list(p)).collect()} for p in ((a, b), (b, a)))
    assert one == two and one["x"] == one["y"]


def test_diversity_golden(spark):
    clique = [f"god{i}" for i in range(1, 6)]
    adj = {c: set(clique) - {c} for c in clique} | {"distinct1": set()}
    cands = list(zip([*clique, "distinct1"], (0.95, 0.94, 0.93, 0.92, 0.91, 0.80)))
    got = graph.mmr_py(cands, adj, 3)
    assert [(i, round(s, 3)) for i, s in got] == [("god1", 0.665), ("distinct1", 0.56), ("god2", 0.358)]
    assert [i for i, _ in graph.mmr_py(cands, adj, 4, 1.0)] == [i for i, _ in cands[:4]]
    edges = spark.createDataFrame([(a, b, "X", 1.0) for a in clique for b in clique if a < b], E)
    df = spark.createDataFrame([(0, i, r, n) for n, (i, r) in enumerate(cands)], "query_id int, id string, relevance double, rank int")
    rows = graph.mmr(df, edges, 3).orderBy("pick").collect()
    assert [r.id for r in rows] == ["god1", "distinct1", "god2"]


def test_redundancy_columns(spark):
    df = spark.createDataFrame([("a", ["b"], "b", ["a"]), ("a", ["x", "y"], "b", ["y", "z"]), ("a", None, "b", ["a"]), ("a", [], "b", ["c"])], "a string, na array<string>, b string, nb array<string>")
    got = [r.r for r in df.select(graph.redundancy(F.col("a"), F.col("na"), F.col("b"), F.col("nb")).alias("r")).collect()]
    assert got == [1.0, pytest.approx(1 / 3), 0.0, 0.0]


def test_top_k(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", [2.0, 0.0])], "id string, vector array<float>")
    assert [(r.id, round(r.score, 4)) for r in vectors.top_k(v, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("d", 1.0), ("c", 0.7071)]


def test_top_k_in_blocks(spark):
    v = spark.createDataFrame([(str(i), [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id string, vector array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(9)], "query_id int, query array<float>")
    one, many = ({(r.query_id, r.rank, r.id) for r in vectors.top_k_batch(v, q, 4, b).collect()} for b in (100, 2))
    assert one == many and len(one) == 36


def folded(rows):
    """The fold, done row by row over the whole table."""
    t = {}
    for old, new, c in rows:
        root = t[new][1] if new in t else new
        t[old] = (new, root, c)
        for k, (n, r, cc) in list(t.items()):
            if r == old:
                t[k] = (n, root, cc)
    return t


def test_alias_fold(spark):
    assert {k: v[1] for k, v in alias.fold_py([("node-A", "node-B", "1"), ("node-B", "node-C", "2")]).items()} == {"node-A": "node-C", "node-B": "node-C"}
    assert {k: v[1] for k, v in alias.fold_py([("X", "A", "1"), ("A", "B", "2"), ("A", "C", "3")]).items()} == {"X": "B", "A": "C"}
    rnd = random.Random(1)
    for _ in range(300):
        rows = [(f"{rnd.randrange(6)}", f"{rnd.randrange(6)}", str(i)) for i in range(rnd.randrange(1, 12))]
        rows = [r for r in rows if r[0] != r[1]]
        assert alias.fold_py(rows) == folded(rows)


def test_alias_record_and_closure(spark):
    empty = spark.createDataFrame([], "old_id string, new_id string, root_id string, commit_hash string")
    rnd = random.Random(2)
    rows = [(f"{g}{rnd.randrange(5)}", f"{g}{rnd.randrange(5)}", str(i)) for i, g in enumerate("abab" * 6)]
    rows = [r for r in rows if r[0] != r[1]]
    half = len(rows) // 2
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, old_id string, new_id string, commit_hash string")
    first = alias.record(empty, events.where(f"seq < {half}"))
    both = alias.record(first, events.where(f"seq >= {half}"))
    assert {r.old_id: (r.new_id, r.root_id, r.commit_hash) for r in both.collect()} == folded(rows)
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "old_id string, new_id string")
    assert {r.root_id for r in alias.closure(chain).collect()} == {"9"}
    ids = spark.createDataFrame([("3",), ("zz",)], "id string")
    assert {r.id: r.root for r in alias.resolve(ids, alias.closure(chain)).collect()} == {"3": "9", "zz": "zz"}


def tangle(n, hubs):
    """Edges with parallel ones, self-loops, circles and hubs: node -> (target, type, weight) in order."""
    rnd = random.Random(17)
    edges = {}
    for i in range(n):
        for _ in range(rnd.choice([0, 1, 2, 3, 9])):
            edges[f"n{i}", f"n{rnd.randrange(n)}", rnd.choice(["A", "B"])] = rnd.choice([1.0, 2.0, 0.5, 7.0])
        for h in hubs:
            edges[f"n{h}", f"n{i}", "A"] = 1.0 + (i + h) % 3
    out = {}
    for (a, b, t), w in sorted(edges.items()):
        out.setdefault(a, []).append((b, t, w))
    return out


def settled(out, seed, alpha, eps, budget):
    state = graph.start(seed)
    known = {u: [(b, w, len(out.get(b, []))) for b, _, w in e] for u, e in out.items()}
    assert graph.advance(state, known | {b: [] for e in out.values() for b, *_ in e if b not in known} | {seed: known.get(seed, [])}, alpha, eps, budget)
    return state["p"]


def table_says(out, walk, need, hub, eps):
    """What the edge table answers, in plain Python."""
    rows = []
    row = lambda kind, node, target, type_, weight, degree: {"kind": kind, "node": node, "target": target, "type": type_, "weight": weight, "degree": degree}
    for u in need.get("nodes", []):
        o = out.get(u, [])
        rows += [row("hub", u, None, None, sum(w for *_, w in o), None)] if len(o) > hub else [row("edge", u, t, ty, w, len(out.get(t, []))) for t, ty, w in o]
    for h, t in need.get("pairs", []):
        if w := sum(w for b, _, w in out[h] if b == t):
            rows.append(row("pair", h, t, None, w, None))
    if need.get("scan"):
        asked, due = walk.ask(need), {}
        for s in asked["shares"]:
            for b, _, w in out[s["hub"]]:
                due[b] = due.get(b, 0) + s["share"] * w
        for o in asked["owed"]:
            due[o["target"]] = due.get(o["target"], 0) + o["amount"]
        mine = sorted({b for b, *_ in out[need["scan"]]} - set(asked["queued"]))
        rows += [row("next", None, t, None, None, None) for t in [t for t in mine if due[t] / max(1, len(out.get(t, []))) >= eps][: asked["room"]]]
    return rows


@pytest.mark.parametrize("hub", [0, 3, 8, 10**9])
def test_a_walk_that_leaves_hubs_in_the_table(hub):
    """However few edges make a hub, the settled mass is that of the model, and a state holds no hub's edges."""
    out = tangle(60, (7, 11))
    for alpha, eps, budget in ((0.1, 1e-5, 40), (0.5, 1e-2, 12)):
        for i in range(60):
            walk, need, rounds = graph.Walk(f"n{i}"), {"nodes": [f"n{i}"]}, 0
            while need is not None:
                walk.learn(table_says(out, walk, need, hub, eps), need)
                need, rounds = walk.run(alpha, eps, budget), rounds + 1
                assert rounds < 4 * budget and all(not isinstance(e, list) or len(e) <= hub for e in walk.known.values())
            assert walk.p == pytest.approx(settled(out, f"n{i}", alpha, eps, budget))


def test_rounds_past_hubs(spark):
    out = tangle(40, (7,))
    df = spark.createDataFrame([(u, b, t, w) for u, e in out.items() for b, t, w in e], E)
    seeds = ["n7", "n3", "n20", "alone"]
    got = {}
    for r in graph.local_push(df, spark.createDataFrame([(s,) for s in [*seeds, None]], "seed string"), 0.3, 1e-3, 7, small=0, hub=8).collect():
        got.setdefault(r.seed, {})[r.id] = r.score
    assert got == {s: pytest.approx(settled(out, s, 0.3, 1e-3, 7)) for s in seeds}


def test_a_hub_of_many_edges(spark):
    """A hub of 200,000 edges: an answer holds no more of them than fit the queue."""
    n = 200_000
    far = spark.range(n).select(F.lit("h").alias("source_id"), F.format_string("t%07d", "id").alias("target_id"), F.lit("A").alias("type"), F.when(F.col("id") % 100_000 == 7, 50_000.0).otherwise(1.0).alias("weight"))
    near = spark.createDataFrame([("t0000007", "t0100007", "A", 3.0)], E)
    got = {r.id: r.score for r in graph.local_push(far.unionByName(near), spark.createDataFrame([("h",)], "seed string"), 0.1, 1e-3, 5, small=0).collect()}
    out = {"t0000007": [("t0100007", "A", 3.0)], "h": [(f"t{i:07d}", "A", 50_000.0 if i % 100_000 == 7 else 1.0) for i in range(n)]}
    assert got == pytest.approx(settled(out, "h", 0.1, 1e-3, 5)) and len(got) == 3


def test_walks_past_hubs_that_share_targets(spark):
    """Hubs with targets in common, some of which the walk knows, has pushed or has queued already; a weight below zero."""
    rnd = random.Random(3)
    edges = {(h, f"t{i:02}", "A"): float(rnd.choice([1, 1, 2, 5, 9])) for h in ("h0", "h1", "h2") for i in range(60) if rnd.random() < 0.6}
    edges |= {("s", x, "A"): w for x, w in (("h0", 3.0), ("h1", 2.0), ("t07", 0.1), ("t50", 1.0))}
    edges |= {(f"t{i:02}", f"h{i % 3}", "B"): 1.0 for i in range(0, 60, 4)} | {("t50", "t51", "B"): 2.0, ("t50", "s", "B"): 1.0}
    for extra, eps, budget in (({}, 1e-3, 40), ({}, 8e-3, 12), ({}, 2e-3, 5), ({("h1", "t59", "A"): -0.5}, 1e-3, 12)):
        out = {}
        for (a, b, t), w in sorted((edges | extra).items()):
            out.setdefault(a, []).append((b, t, w))
        df = spark.createDataFrame([(u, b, t, w) for u, e in out.items() for b, t, w in e], E)
        got = {}
        for r in graph.local_push(df, spark.createDataFrame([("s",), ("h2",), ("t08",)], "seed string"), 0.2, eps, budget, small=0, hub=4).collect():
            got.setdefault(r.seed, {})[r.id] = r.score
        assert got == {s: pytest.approx(settled(out, s, 0.2, eps, budget)) for s in ("s", "h2", "t08")}


def test_a_front_has_the_first_by_name_for_every_share(spark):
    rnd = random.Random(4)
    rows = [(h, h == "b", f"t{i:05}", rnd.choice([rnd.random(), 0.5]), rnd.choice([0, 1, 3])) for h in "ab" for i in range(3000)]
    kept = {}
    for r in graph.fronts(spark.createDataFrame(rows, "node string, shared boolean, target_id string, weight double, degree int").repartition(5), 6, 4).collect():
        kept.setdefault(r.node, []).append((r.target_id, r.weight / max(1, r.degree)))
    for h in "ab":
        every = [(t, w / max(1, d)) for node, _, t, w, d in rows if node == h]
        assert len(kept[h]) < 150
        for low in (0, 0.1, 0.3, 0.5, 0.9, 0.99, 0.999):
            first = lambda edges, low=low: sorted(t for t, x in edges if x >= low)[:6]
            assert first(kept[h]) == first(every)


def test_walks_do_not_meet_all_edges_of_their_hub(spark):
    """What is shuffled grows with walks and with edges, not with their product."""
    n, walkers = 4000, 100
    far = spark.range(n).select(F.lit("h").alias("source_id"), F.format_string("t%05d", "id").alias("target_id"), F.lit("A").alias("type"), (F.col("id") % 97 + 1.0).alias("weight"))
    near = spark.range(walkers).select(F.format_string("s%d", "id").alias("source_id"), F.lit("h").alias("target_id"), F.lit("A").alias("type"), F.lit(1.0).alias("weight"))
    store = spark._jsc.sc().statusStore()
    done = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = done()
    got = graph.local_push(far.unionByName(near), near.select(F.col("source_id").alias("seed")), 0.3, 1e-5, 4, small=0, hub=100).count()
    assert got == 4 * walkers and done() - before < walkers * n / 4


def test_pruned_search_is_exact(spark):
    """Against every text, with ties, empty texts and fewer texts than k; and most postings are left unread."""
    from trailhead.functions import text
    from trailhead.operators import postings

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rnd.choices(words[(i % 8) * 50 : (i % 8) * 50 + 50], k=rnd.randint(1, 12)))) for i in range(900)]
    docs += [(900 + i, docs[i][1]) for i in range(30)] + [(950, None), (951, ""), (952, "the of")]
    v = text.embed_sparse(spark.createDataFrame(docs, "id long, t string"), "t").select("id", "embedding").persist()
    asked = v.where("id % 50 = 0 OR id > 948").selectExpr("id query_id", "embedding")
    got, share = postings.search(postings.index(v, 64), asked, 4, block=7)
    dense = {r.id: {x.bucket: x.v for x in r.embedding} for r in v.collect()}
    norm = {i: sum(x * x for x in e.values()) ** 0.5 for i, e in dense.items()}
    have = {}
    for r in got.collect():
        have.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 9)))
    for q in [r.query_id for r in asked.collect()]:
        score = lambda i, q=q: round(sum(x * dense[i].get(b, 0) for b, x in dense[q].items()) / (norm[q] * norm[i]), 12) if norm[q] and norm[i] else 0.0
        want = sorted(((-score(i), i) for i in dense))[:4]
        assert sorted(have[q]) == [(n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(want)]
    read = share.first()
    assert 0 < read["read"] < 0.6 * read.total
    few, _ = postings.search(postings.index(v.where("id < 3")), asked.limit(1), 10)
    assert few.count() == 3
    v.unpersist()


def test_pruned_search_scores_in_double_what_single_precision_cannot_tell(spark):
    """Scores that differ by less than single precision shows keep their order; most pairs are never scored in double precision."""
    from trailhead.operators import postings

    rnd = random.Random(5)
    near = [(i, [(b, 1000 + (b * 7919 + i) % 3) for b in range(0, 384, 2)]) for i in range(300)]
    far = [(300 + i, [(b, rnd.randint(-9, 9) or 1) for b in range(384)]) for i in range(300)]
    v = spark.createDataFrame(near + far, "id long, embedding array<struct<bucket:int,v:int>>").repartition(3)
    asked = v.where("id % 60 = 7").selectExpr("id query_id", "embedding")
    got, share = postings.search(postings.index(v, 64), asked, 5)
    m = np.zeros((600, 384))
    for i, e in near + far:
        m[i, [b for b, _ in e]] = [x for _, x in e]
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    have = {}
    for r in got.collect():
        have.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 11)))
    for q in range(7, 600, 60):
        s = np.round(m @ m[q], 12)
        want = sorted(range(600), key=lambda i: (-s[i], i))[:5]
        assert sorted(have[q]) == [(n + 1, i, round(s[i], 11)) for n, i in enumerate(want)]

    one = m[:256]
    rows, own = np.nonzero(one)
    order = np.lexsort((rows, own))
    seg = postings.Segment({"cuts": np.searchsorted(own[order], np.arange(385)).astype("<i4").tobytes(), "texts": rows[order].astype("<i4").tobytes(), "own_cuts": np.searchsorted(rows, np.arange(257)).astype("<i4").tobytes(), "own": own.astype("<i4").tobytes(), "own_weights": one[rows, own].tobytes()}, 384)
    questions, floor = postings.Questions(m[300:]), np.full(300, 0.9)
    who, _, score, read = questions.search(seg, 0, 300, floor, 5)
    assert not len(who) and read > 0 and seg.half.dtype == np.float32
    who, text, score, _ = questions.search(seg, 10, 20, np.full(10, -np.inf), 5)
    assert 50 <= len(who) < 2560 and np.allclose(score, np.einsum("ij,ij->i", m[310 + who], one[text]), atol=1e-15)
