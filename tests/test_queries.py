"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from trailhead.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(df, con, sql):
    rel = con.execute(sql)
    cols = sorted(x[0] for x in rel.description)
    assert cols == sorted(df.columns)
    order = [[x[0] for x in rel.description].index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    if name in q.ORACLE_SQL:
        same(df, duck, q.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["pos", "node_id", "file_path", "snippet_sha256", "uncertain"]
    assert set(e.oracle_sql()) <= set(e.queries())


# --- queries without SQL, against scalar models over the same tables


def rows(duck, sql):
    return duck.execute(sql).fetchall()


TRADE = """SELECT 'c:' || o_custkey, 'p:' || l_partkey, 'CALLS', count(*)::DOUBLE FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'CALLS', count(*)::DOUBLE FROM lineitem GROUP BY ALL"""


def test_pushes_equal_the_model(spark, duck):
    from test_graph import model

    from trailhead.operators import graph

    edges = rows(duck, TRADE)
    got = {}
    for r in q.QUERIES["q_local_push"](spark, SF).collect():
        got.setdefault(r.seed, {})[r.id] = r.score
    fused = {}
    for r in q.QUERIES["q_dual_horizon"](spark, SF).orderBy("seed", "rank").collect():
        fused.setdefault(r.seed, []).append(r.id)
    for (seed,) in rows(duck, "SELECT 'c:' || c_custkey FROM customer WHERE c_custkey % 50 = 0"):
        wide, tight = model(edges, seed, *graph.WIDE, graph.BUDGET), model(edges, seed, *graph.TIGHT, graph.BUDGET)
        assert got[seed] == pytest.approx(wide, abs=1e-8)
        score = {}
        for p in (tight, wide):
            for rank, i in enumerate(sorted(p, key=lambda i: (-p[i], i)), 1):
                score[i] = score.get(i, 0) + 1 / (60 + rank)
        assert fused[seed] == sorted(score, key=lambda i: (-score[i], i))[: graph.BUDGET]


def test_diversity_equals_the_model(spark, duck):
    from trailhead.operators import graph

    adj = {}
    for s, p in rows(duck, "SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey FROM lineitem"):
        adj.setdefault(s, set()).add(p)
        adj.setdefault(p, set()).add(s)
    given = {}
    for n, i, rel in rows(duck, "SELECT s_nationkey, 's:' || s_suppkey, s_acctbal / 10000 FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey"):
        given.setdefault(n, []).append((i, rel))
    lists = {n * 1_000_000 + at // 40: c[at : at + 40] for n, c in given.items() for at in range(0, len(c), 40)}  # every supplier is in one
    want = {(n, k, i) for n, c in lists.items() for k, (i, _) in enumerate(graph.mmr_py(c, adj, 10), 1)}
    assert {(r.query_id, r.pick, r.id) for r in q.QUERIES["q_mmr"](spark, SF).collect()} == want


def test_alias_fold_equals_the_model(spark, duck):
    from test_graph import folded

    ev = {}
    for u, e, t in rows(duck, "SELECT user_id, event_id, event_type FROM events ORDER BY user_id, event_id"):
        ev.setdefault(u, []).append((f"{u}/{t}", str(e)))
    want = {}
    for u, x in ev.items():
        want |= folded([(a, b, c) for (a, c), (b, _) in zip(x, x[1:]) if a != b])
    assert {r.old_id: (r.new_id, r.root_id, r.commit_hash) for r in q.QUERIES["q_alias_fold"](spark, SF).collect()} == want
