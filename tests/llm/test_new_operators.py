import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from trailhead.llm import clustering, mixing, queries, repair, runtime

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_repair", "op12_clusters", "op13_mixture"])
def test_query_equals_sql(spark, duck, name):
    rel = duck.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in rel.description]
    key = lambda r: tuple(str(x) for x in r)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted(rel.fetchall(), key=key)


# --- op 11

FORM = re.compile("(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string, extra string, _c string, kind int, edits string"


def damaged(rows):
    """The rule in plain Python: conversation -> rows (turn, role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        mine += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def model(rows):
    """Forward search: the least (cost, letters) for every prefix of the form, with the rows it makes."""
    seen, blank, dup, cuts, stays = set(), 0, 0, 0, []
    for _, role, text in rows:
        solid = re.findall("[^ \t-\r]", text)
        again = (role, text) in seen
        seen.add((role, text))
        cut = bool(solid) and solid[-1] not in ".!?"
        blank += not solid
        dup += bool(solid) and again
        cuts += bool(solid) and not again and cut
        stays.append((bool(solid) and not again, cut))
    best = {"": (0, "", ())}
    grows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def relax(best):
        for _ in range(4):
            for state, (cost, letters, made) in list(best.items()):
                for nxt in grows[state]:
                    if nxt != "s":
                        new = (cost + 2, letters + "I", (*made, ({"u": "user", "a": "assistant"}[nxt], "")))
                        best[nxt] = min(best.get(nxt, (math.inf,)), new)
        return best

    for (_, role, text), (may, cut) in zip(rows, stays):
        after = {}
        for state, (cost, letters, made) in relax(best).items():
            options = [(state, (cost + 3, letters + "D", made))]
            if may:
                for nxt in grows[state]:
                    if role[:1] == nxt:
                        options.append((nxt, (cost + cut, letters + "K", (*made, (role, text)))))
                    if nxt != "s":
                        options.append((nxt, (cost + 2 + cut, letters + "R", (*made, ({"u": "user", "a": "assistant"}[nxt], text)))))
            for nxt, new in options:
                after[nxt] = min(after.get(nxt, (math.inf,)), new)
        best = after
    relax(best)
    cost, letters, made = min(best[s] for s in ("", "a") if s in best)
    assert FORM.fullmatch("".join(r[0] for r, _ in made))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, blank, dup, cuts, illegal, cost, letters, digest)


def repaired(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y", 7, "z") for r in rows], TURNS).repartition(parts)
    got = repair.repair(repair.damage(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out = got.collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_repair_is_the_cheapest_and_least(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["yes.", "no", " \t", "", None, "why? ", "so it is!\n", "a b", "é", "Я。"]
    rows = []
    for conv in [None, *range(160)]:
        for _ in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)))
    assert repaired(spark, rows) == {c: model(r) for c, r in damaged(rows).items()}


def test_repair_of_one_long_conversation_among_small_ones(spark):
    """It spans every partition; a third of its rows are equal."""
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["same.", f"text {t}", f"text {t}."])) for t in range(3000)]
    rows += [(7, 5000, "user", "same row.")] * 1000
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(8, 30) for t in range(4)]
    assert repaired(spark, rows) == {c: model(r) for c, r in damaged(rows).items()}


def test_repair_of_nothing(spark):
    assert repaired(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "a.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repair_tables_compose():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, cut = 9, int(rng.integers(1, 8))
        stays, code, trunc = rng.random(n) < 0.7, rng.integers(0, 4, n), rng.random(n) < 0.3
        whole = repair.table_of(stays, code, trunc)
        a, b = repair.table_of(stays[:cut], code[:cut], trunc[:cut]), repair.table_of(stays[cut:], code[cut:], trunc[cut:])
        assert np.array_equal(np.minimum(whole, 1 << 40), np.minimum((a[:, :, None] + b[None]).min(1), 1 << 40))


# --- op 12


def lloyd(ids, x, k=8, rounds=10, seed=3):
    start = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest() if ids[i] is not None else "", x[i].astype("<i4").tobytes()))[:k]
    c = x[start].astype(object)
    near = lambda: np.array([min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j])), j)) for v in x.astype(object)])
    for _ in range(rounds):
        a = near()
        c = np.array([[sum(col) // int((a == j).sum()) for col in x[a == j].astype(object).T] if (a == j).any() else list(c[j]) for j in range(len(c))], object)
    a = near()
    return a, [sum((p - q) ** 2 for p, q in zip(v, c[j])) for v, j in zip(x.astype(object), a)], c


VECTORS = "vec_id long, embedding array<double>, cluster int, _x string"


@pytest.mark.parametrize("kind", ["blobs", "ties", "few", "large"])
def test_clusters_are_those_of_full_scans(spark, kind):
    rng = np.random.default_rng(11)
    n = {"few": 5}.get(kind, 240)
    v = rng.normal(size=(n, 64)) * 0.02 + rng.integers(0, 12, n)[:, None] * (0.3 if kind == "blobs" else 0)
    if kind == "ties":
        v = rng.integers(0, 2, (n, 64)) * (np.arange(64) < 3) / 1024  # eight different vectors, many equal distances
        v[:80] = v[0]  # a third of the rows are one vector
    if kind == "large":
        v = rng.integers(-(2**13), 2**13, (n, 64)).astype(float)
    ids = [None, *range(n - 2), 0]  # a null and a repeated id
    df = spark.createDataFrame([(i, r.tolist(), 3, "x") for i, r in zip(ids, v)], VECTORS).repartition(3)
    placed, centroids = clustering.cluster(clustering.quantised(df))
    got = sorted((r["_i"] is not None, r["_i"] or 0, r["cluster"], r["distance"]) for r in placed.collect())
    a, d, c = lloyd(ids, np.floor(v * 1024).astype(np.int64))
    assert got == sorted((i is not None, i or 0, int(p), int(q)) for i, p, q in zip(ids, a, d))
    assert centroids.tolist() == c.tolist()
    out = clustering.report(placed, centroids).collect()
    assert len(out) == n and {r["inertia"] for r in out} == {sum(d)}


def test_vectors_that_do_not_count(spark):
    bad = [(1, None), (2, [0.0] * 63), (3, [0.0] * 65), (4, [None] + [0.0] * 63), (5, [math.nan] + [0.0] * 63), (6, [math.inf] * 64), (7, [-0.0001] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in bad], VECTORS)
    kept = clustering.quantised(df).collect()
    assert [r["_i"] for r in kept] == [7] and set(np.frombuffer(bytes(kept[0]["_x"]), "<i4").tolist()) == {-1}
    placed, centroids = clustering.cluster(clustering.quantised(df.where("vec_id < 7")))
    assert placed.count() == 0 and clustering.report(placed, centroids).count() == 0
    with pytest.raises(Exception, match="do not fit 64 bits"):
        clustering.quantised(spark.createDataFrame([(1, [1e30] * 64, 1, "x")], VECTORS)).collect()


def test_bounds_certify_only_what_is_so():
    """Random moves of centroids: the state is always that of a full scan, and many rows are not measured against all centroids."""
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (400, 64)) + 4000 * rng.integers(0, 9, 400)[:, None]
    for k, b in ((8, 2), (16, 4), (40, 10), (2, 1), (1, 0)):
        c = x[rng.choice(400, k, replace=False)].astype(np.int64)
        state, spared = clustering._full(x, clustering.Round(c, None, b)), 0
        for step in range(8):
            new = c + rng.integers(-300, 300, c.shape) // (step + 1)
            drift = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + 1e-9)
            *state, need = clustering.assign(x, *state, clustering.Round(new, drift, b))
            c = new
            d = clustering.squares(x, c)
            assert np.array_equal(state[0], d.argmin(1))
            true = np.sqrt(d)
            assert (state[1] >= true[np.arange(400), state[0]]).all()
            assert (state[3][:, : state[2].shape[1]] <= np.take_along_axis(true, state[2], 1) * (1 + 1e-12)).all()
            spared += (need < clustering.ALL).sum()
        assert spared > 400 * 8 * 0.3


# --- op 13

DOCS = "doc_id long, text string, source string, size string, copies int, _s int"


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Round by round: what is over the cap is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        unit = rest / sum(w[s] for s in free)
        over = {s for s in free if w[s] * unit > cap * sizes[s]}
        for s in over or free:
            target[s] = cap * sizes[s] if over else w[s] * unit
        rest -= sum(target[s] for s in over)
        free = free - over if over else set()
    return target


def words(text):
    return len(re.findall("[^ \t-\r]+", text or ""))


def corpus():
    rng = random.Random(9)
    rows = [(i, "w " * min(2000, int(rng.paretovariate(1))), "hot" if i % 3 else f"s{i % 17}") for i in range(1500)]
    rows += [(2000 + i, "a\tb\x0b c d " * 9, None) for i in range(30)]
    rows += [(3000, None, "empty"), (3001, " \n", "empty"), (3002, "x", ""), (3003, "y " * 50, "é"), (3004, "y " * 50, "𐀀")]
    rows += [(None, "null id " * 3, "s1")] * 3 + [(3010, "twice " * 4, "s2")] * 300
    return rows


def mixed(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], DOCS).repartition(parts)
    return df, runtime.stored(mixing.plan(df), "plan")


def test_mixture_meets_its_targets(spark):
    rows = corpus()
    df, planned = mixed(spark, rows)
    got = planned.collect()
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted((i or -1, s or "", words(t)) for i, t, s in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = shares(sizes)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(math.isclose(r.target, target, rel_tol=1e-9) for r in mine)
        rate = target / sizes[s] if sizes[s] else 0
        assert all(math.floor(rate) <= r.copies <= math.ceil(rate) <= 3 for r in mine)
        taken = sum(r.copies * r.size for r in mine)
        assert abs(taken - target) <= max(r.size for r in mine)
        # each prefix in the order of size has its expected number of copies, within one
        held = np.cumsum([r.copies for r in sorted(mine, key=lambda r: r.size)])
        assert (np.abs(held - rate * np.arange(1, len(mine) + 1)) <= 1 + 1e-6).all() or len({r.size for r in mine}) < len(mine)


def test_mixture_reruns_agree_on_other_partitions(spark):
    rows = corpus()
    out = [sorted((r.doc_id or -1, r.source or "", r.size, r.copies) for r in mixed(spark, rows, n)[1].collect()) for n in (1, 7)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        out.append(sorted((r.doc_id or -1, r.source or "", r.size, r.copies) for r in mixed(spark, rows)[1].collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1] == out[2]


def test_mixed_corpus_has_the_planned_copies(spark):
    rows = corpus()
    df, planned = mixed(spark, rows)
    want = {}
    for r in planned.collect():
        key = (r.doc_id, r.source, r.size)
        want[key] = want.get(key, 0) + r.copies
    made = mixing.mix(df, planned)
    assert made.columns == df.columns
    have = {}
    for r in made.collect():
        key = (r.doc_id, r.source, words(r.text))
        have[key] = have.get(key, 0) + 1
    assert have == {k: n for k, n in want.items() if n}


def test_mixture_of_nothing_and_of_no_words(spark):
    assert mixed(spark, [])[1].count() == 0
    got = mixed(spark, [(1, "", "a"), (2, None, None)])[1].collect()
    assert [(r.size, r.source_size, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_long_texts_are_counted_in_parts(spark):
    text = "ab  c" * 3 + "x" * (9 << 20) + " y\n" * 10 + "z"
    df = spark.createDataFrame([(1, text, "a", "x", 1, 2), (2, "one", "a", "x", 1, 2)], DOCS).coalesce(1)
    assert [r["size"] for r in mixing.sized(df).collect()] == [words(text), 1]
