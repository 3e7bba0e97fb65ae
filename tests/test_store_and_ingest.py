import subprocess

import pytest
from pyspark.sql import functions as F

from trailhead import schema
from trailhead.operators import ingest, store
from trailhead.plans import retrieve
from trailhead.sources import files, git, parse
from trailhead.streaming import changes

PY = b'''
import os

class Session:
    def login(self, user):
        if user:
            return self.check(user) and audit(user)
        return None

def audit(who):
    for i in range(3):
        print(who, i)

def payload_move(auth, system):
    return login(auth)
'''
CPP = b'''
#include <x>
// int fake(int a) { return a; }
namespace n {
int add(int a, int b) { if (a > b) { return mul(a, b); } return obj.method(a) + ns::helper(b); }
void Foo::bar(const char* s) const { puts("}{"); }
}
'''


def node(i, path="a.cpp", a=0, b=10, h=1, active=True, c=1.0):
    return (i, path, a, b, h, active, c)


def empty(spark):
    return {t: spark.createDataFrame([], schema.TABLES[t]) for t in (*changes.STATEFUL, "traces")}


def rows(spark, *rs, op="U", start=0):
    return spark.createDataFrame([(start + i, p, op if c is not None else "D", "c1", c) for i, (p, c) in enumerate(rs)], changes.CHANGE)


def by(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_and_checks(spark):
    base = spark.createDataFrame([node("a"), node("b")], schema.NODES)
    new = spark.createDataFrame([node("a", b=20), node("c")], schema.NODES)
    assert by(store.upsert_nodes(base, new), "id", "byte_end") == [("a", 20), ("b", 10), ("c", 10)]
    with pytest.raises(Exception, match="does not end after"):
        store.upsert_nodes(base, spark.createDataFrame([node("bad", a=10, b=5)], schema.NODES)).collect()
    h = spark.createDataFrame([("a", "c", 1, "x"), ("b", "c", 1, "")], schema.HISTORY)
    assert by(store.record_history(h.limit(0), h), "node_id", "synthetic_msg") == [("a", "x"), ("b", None)]
    seq = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid")], "id string, s long, v string")
    assert by(store.latest(seq, ["id"], "s"), "v") == [("new",)]


def test_tombstone_and_foreign_keys(spark):
    n = spark.createDataFrame([node("a"), node("b"), node("c")], schema.NODES)
    e = spark.createDataFrame([("a", "b", "X", 1.0), ("b", "c", "X", 1.0), ("a", "c", "X", 1.0)], schema.EDGES)
    n2, e2 = store.tombstone(n, e, spark.createDataFrame([("b",)], "id string"))
    assert by(n2, "id", "is_active") == [("a", True), ("b", False), ("c", True)] and by(e2, "source_id", "target_id") == [("a", "c")]
    more = spark.createDataFrame([("a", "nowhere", "X", 1.0), ("a", "c", "X", 5.0)], schema.EDGES)
    assert by(store.upsert_edges(e2, more, n2), "target_id", "weight") == [("c", 5.0)]
    assert by(store.by_simhash(n2, n, True), "id") == [("a",)]


def test_python_and_c_spans():
    got = parse.spans("a.py", PY)
    assert [(s[2], s[3]) for s in got] == [("login", ["self", "audit"]), ("audit", ["range", "print"]), ("payload_move", ["login"])]
    assert PY[got[1][0] : got[1][1]].startswith(b"def audit(who):") and all(s[5] == 1.0 for s in got)
    renamed = parse.spans("a.py", PY.replace(b"audit", b"inspect").replace(b"who", b"person"))
    assert [s[4] for s in renamed] == [s[4] for s in got]
    assert parse.spans("a.py", PY.replace(b"for i", b"while True:\n        pass\n    for i"))[1][4] != got[1][4]
    c = parse.spans("a.cpp", CPP)
    assert [(s[2], s[3]) for s in c] == [("add", ["mul", "obj", "helper"]), ("bar", ["puts"])]
    assert CPP[c[0][0] : c[0][1]].startswith(b"int add(") and CPP[c[0][0] : c[0][1]].endswith(b"}")
    broken = parse.spans("b.py", b"def x(:\n")
    assert len(broken) == 1 and broken[0][5] == 0.0 and "SyntaxError" in broken[0][6]
    assert parse.spans("notes.txt", b"hi")[0][:3] == (0, 2, "")


def test_ingest_links_renames_and_is_idempotent(spark):
    t = empty(spark)
    t1, stats = ingest.apply(t, rows(spark, ("a.py", PY), ("c.cpp", CPP), ("n.txt", b"plain")))
    s = stats.first()
    assert (s.files_processed, s.nodes_upserted, s.parse_failures, s.paths_tombstoned) == (3, 6, 0, 0)
    n = {r.id: r for r in t1["nodes"].collect()}
    assert not n["sym:audit"].is_active and n["sym:audit"].byte_end == 1
    names = {r.old_id: r.root_id for r in t1["alias"].collect()}
    login = names["sym:login"]
    assert n[login].file_path == "a.py" and n[login].parse_confidence == 1.0
    e = by(t1["edges"], "source_id", "target_id", "type")
    assert (login, "sym:audit", "CALLS") in e and (login, "sym:login", "IMPLEMENTS") in e
    again, s2 = ingest.apply(t1, rows(spark, ("a.py", PY), ("n.txt", b"plain"), start=10))
    assert s2.first().nodes_upserted == 0 and s2.first().nodes_skipped == 1
    for k in ("nodes", "edges", "alias"):
        assert by(again[k], *schema.TABLES[k].fieldNames()) == by(t1[k], *schema.TABLES[k].fieldNames())
    # the same shape in another file renames the old node
    moved, _ = ingest.apply(t1, rows(spark, ("b.py", b"def inspect(person):\n    for i in range(3):\n        print(person, i)\n"), start=20))
    audit = names["sym:audit"]
    al = {r.old_id: r.root_id for r in moved["alias"].collect()}
    assert al[audit] == al["sym:inspect"] == al["sym:audit"] and n[audit].file_path == "a.py"
    gone, s3 = ingest.apply(t1, rows(spark, ("a.py", None), ("c.cpp", b""), start=30))
    assert s3.first().paths_tombstoned == 2 and not any(r.is_active for r in gone["nodes"].where("file_path IN ('a.py', 'c.cpp')").collect())
    assert gone["edges"].isEmpty() and gone["vectors"].count() == 1


def test_question_path_trace_and_answer(spark):
    t, _ = ingest.apply(empty(spark), rows(spark, ("a.py", PY), ("c.cpp", CPP)))
    t = {k: retrieve.graph.session.checkpointed(v) for k, v in t.items()}
    fs = spark.createDataFrame([("a.py", PY), ("c.cpp", CPP)], "file_path string, content binary")
    built = retrieve.build(t, fs, "How does the auth payload move through the system?", created_at=7)
    assert built.ok
    r = built.request.first()
    assert r.context[0].codeSnippet.startswith("def payload_move") and r.requireCitations and len(r.context) <= 10
    assert not r.context[0].uncertain
    kept, out = retrieve.replay(built.traces, built.trace_id, t["nodes"], t["edges"])
    assert by(kept, "id") == by(built.nodes, "id") and built.traces.first().created_at == 7
    shown = retrieve.render(retrieve.snippets(kept, fs), out).first().text
    assert "FILE: a.py" in shown and "CONFIDENCE: HIGH" in shown and "-> CALLS sym:logi..." in shown
    assert retrieve.replay(built.traces, "unknown", t["nodes"], t["edges"])[0].isEmpty()
    assert not retrieve.build(t, fs, "zzzz qqqq").ok
    assert not retrieve.build(t | {"vectors": t["vectors"].limit(0)}, fs, "auth").ok
    good = retrieve.answer(t, fs, "How does the auth payload move?", lambda s, u: f"It moves [node:{r.context[0].nodeId}]")
    bad = retrieve.answer(t, fs, "How does the auth payload move?", lambda s, u: "It moves [node:made-up]")
    none = retrieve.answer(t, fs, "How does the auth payload move?")
    assert good["verified"] is True and bad["verified"] is False and retrieve.UNVERIFIED in bad["text"] and none["verified"] is None and "FILE: a.py" in none["text"]


def test_verify_and_empty_render(spark):
    n = spark.createDataFrame([node("real-node-1", "x.cpp", 0, 5, active=False)], schema.NODES)
    a = spark.createDataFrame([("1", "see [node:real-node-1]"), ("2", "see [node:does-not-exist]"), ("3", None)], "answer_id string, text string")
    assert by(retrieve.verify(a, n), "answer_id", "all_valid", "invalid_ids") == [("1", True, []), ("2", False, ["does-not-exist"]), ("3", True, [])]
    none = n.limit(0).withColumns({"rank": F.lit(0), "snippet": F.lit("")})
    assert retrieve.render(none, spark.createDataFrame([], schema.EDGES)).first().text == ""


def test_files_and_git(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.py").write_bytes(PY)
    (repo / "d.md").write_text("x")
    run("add", "."), run("commit", "-qm", "first")
    (repo / "a.py").write_bytes(PY + b"\n")
    (repo / "sub").mkdir()
    (repo / "sub/b.cc").write_bytes(CPP)
    (repo / "d.md").unlink()
    run("add", "-A"), run("commit", "-qm", "second\n\nbody")
    assert by(files.scan(spark, str(repo)), "file_path") == [("a.py",), ("sub/b.cc",)]
    c = git.changes(spark, str(repo)).orderBy("topo", "file_path").collect()
    assert [(r.file_path, r.status, r.message) for r in c] == [("a.py", "M", "second\n\nbody"), ("sub/b.cc", "A", "second\n\nbody"), ("a.py", "A", "first"), ("d.md", "A", "first")]
    assert bytes(c[1].content) == CPP and c[2].parent is None
    with pytest.raises(Exception, match="not a git repository"):
        git.changes(spark, str(tmp_path)).collect()
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 9), ("d", 4)], "k string, v int")
    assert by(git.diff(old, new, ["k"], "v"), "k", "status") == [("b", "modified"), ("c", "deleted"), ("d", "added")]


def test_stream_equals_batch(spark, tmp_path):
    every = rows(spark, ("a.py", PY), ("c.cpp", CPP), ("b.py", b"def f(x):\n    return x\n"), ("a.py", PY.replace(b"audit", b"inspect")), ("c.cpp", None))
    src = str(tmp_path / "in")
    for i in range(5):
        every.where(f"seq = {i}").coalesce(1).write.mode("append").parquet(src)
    st = store.Store(spark, str(tmp_path / "store"))
    changes.run(spark, src, st, str(tmp_path / "cp"), files_per_batch=1)
    assert st.version() == 5 and st.last_batch() == 4
    assert changes.apply_batch(st, every, 3) is None  # delivered again
    active = by(st.read("nodes").where("is_active"), "file_path", "parse_confidence")
    want, _ = ingest.apply(empty(spark), every)
    assert active == by(want["nodes"].where("is_active"), "file_path", "parse_confidence")
    assert by(st.read("edges"), "type", "target_id") == by(want["edges"], "type", "target_id") or set(by(want["edges"], "target_id")) <= set(by(st.read("edges"), "target_id"))
    assert changes.ndjson(st.read("errors").limit(0)).columns == ["value"]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    """Twice with new files between, once with none, and from nothing; deltas are folded meanwhile."""
    from pyspark.sql import types as T

    from trailhead.streaming import changes

    kind = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.StringType())])
    place = lambda x: f"file://{tmp_path}/{x}"
    run = lambda: {r.k: (r.n, r.v) for r in changes.upsert_stream(spark, place("in"), kind, ["k"], ["n"], place("out"), place("check"), compact=3).collect()}
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(place("in"))
    (tmp_path / "in").mkdir()
    assert run() == {}
    put([(1, 1, "a"), (2, 5, "b")])
    put([(1, 3, "c")])
    assert run() == {1: (3, "c"), 2: (5, "b")}
    assert run() == {1: (3, "c"), 2: (5, "b")}
    put([(1, 2, "late"), (3, 1, "new")])
    put([(2, 6, "newer")])
    assert run() == {1: (3, "c"), 2: (6, "newer"), 3: (1, "new")} == run()
    assert any(p.name.startswith("base") for p in (tmp_path / "out").iterdir())


def bytes_below(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet")) if path.exists() else 0


def edge_rows(spark, lo, hi, weight):
    return spark.range(lo, hi).select(F.concat(F.lit("a"), "id").alias("source_id"), F.concat(F.lit("b"), "id").alias("target_id"), F.lit("CALLS").alias("type"), F.lit(weight).alias("weight"))


def test_two_writers_of_a_version(spark, tmp_path):
    """However long a writer has stalled, one version has one writer, and the other's rows are not seen."""
    folder = f"file://{tmp_path}/s"
    one, two = store.Store(spark, folder), store.Store(spark, folder)
    error = lambda m: spark.createDataFrame([("p", m, None)], schema.TABLES["errors"])
    assert one.upsert({"errors": error("first")}) == 1
    stalled = one.version()  # the first writer has read its base and stops here
    assert two.upsert({"errors": error("second")}) == 2
    with pytest.raises(store.Conflict):
        one.upsert({"errors": error("late")}, based_on=stalled)
    with pytest.raises(store.Conflict):
        one.publish({"errors": error("late")}, based_on=stalled)
    assert by(two.read("errors"), "message") == [("second",)] and by(one.read("errors", 1), "message") == [("first",)]
    assert one.publish({"errors": error("third")}) == 3 and one.versions() == [1, 2, 3]
    assert one.files.create(f"{folder}/manifest/000000000003.json", "{}") is False
    gone = one.prune(1)
    assert gone and one.versions() == [3] and by(two.read("errors"), "message") == [("third",)]


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/s", bucket_rows=2000)
    st.upsert({"edges": edge_rows(spark, 0, 40_000, 1.0)})
    base = bytes_below(tmp_path / "s")
    assert st.layers("edges")["buckets"] == 20
    before = base
    st.upsert({"edges": edge_rows(spark, 100, 500, 2.0)})  # 1 %
    assert bytes_below(tmp_path / "s") - before < 0.03 * base
    assert sorted(st.layers("edges")["base"].values()) and len(st.layers("edges")["deltas"]) == 1
    gone = edge_rows(spark, 200, 240, 0.0).withColumn("_gone", F.lit(True))  # a tombstone of 0.1 % rewrites no base file
    kept = st.layers("edges")["base"]
    st.upsert({"edges": gone})
    assert st.layers("edges")["base"] == kept
    got = {r.source_id: r.weight for r in st.read("edges").collect()}
    assert len(got) == 40_000 - 40 and got["a150"] == 2.0 and got["a99"] == got["a500"] == 1.0 and "a200" not in got
    plan = st.read("edges")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan  # no base row is shuffled


def test_layers_against_a_dictionary(spark, tmp_path):
    """Many batches of upserts and deletes: merged levels, folded buckets and a table that outgrows its buckets."""
    rnd = __import__("random").Random(4)
    st, have, seen = store.Store(spark, f"file://{tmp_path}/s", bucket_rows=60), {}, set()
    kind = "id string, vector array<float>, _gone boolean"
    for step in range(26):
        n = 5 if step % 6 else 120
        keys = rnd.sample(range(600), n)
        rows = [(f"k{k}", [float(step)], rnd.random() < 0.2) for k in keys]
        for k, v, gone in rows:
            have.pop(k, None) if gone else have.update({k: v})
        assert st.upsert({"vectors": spark.createDataFrame(rows, kind).coalesce(1)}) == step + 1
        now = st.layers("vectors")
        seen |= {("level", d["level"]) for d in now["deltas"]} | {("buckets", now["buckets"])}
        if step % 5 == 0 or step == 25:
            assert {r.id: list(r.vector) for r in st.read("vectors").collect()} == have
    assert len([x for x in seen if x[0] == "buckets"]) > 1
    st.prune(1)
    assert {r.id: list(r.vector) for r in st.read("vectors").collect()} == have


def test_deltas_of_a_level_become_one(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/s", bucket_rows=100_000)
    st.upsert({"edges": edge_rows(spark, 0, 3000, 1.0).coalesce(1)})
    for i in range(8):
        st.upsert({"edges": edge_rows(spark, 10 * i, 10 * i + 20, 2.0 + i).coalesce(1)})
    now = st.layers("edges")
    assert [d["level"] for d in now["deltas"]] == [1] and sum(now["deltas"][0]["rows"].values()) == 90
    got = {r.source_id: r.weight for r in st.read("edges").collect()}
    assert got["a5"] == 2.0 and got["a15"] == 3.0 and got["a89"] == 9.0 and got["a90"] == 1.0 and len(got) == 3000


def test_an_older_schema_is_read_and_upgraded(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    old, new = store.Store(spark, folder, at=1), store.Store(spark, folder)
    old.upsert({"errors": spark.createDataFrame([("a.py", "SyntaxError: no"), ("b.py", "odd")], "path string, message string")})
    assert old.read("errors").columns == ["path", "message"] and new.layers("errors")["schema"] == 1
    assert by(new.read("errors"), "path", "kind") == [("a.py", "SyntaxError"), ("b.py", None)]
    new.upsert({"errors": spark.createDataFrame([("c.py", "IndentationError: x", "IndentationError")], schema.TABLES["errors"])})
    assert new.layers("errors")["schema"] == 2 and by(new.read("errors"), "path", "kind") == [("a.py", "SyntaxError"), ("b.py", None), ("c.py", "IndentationError")]
    assert by(old.read("errors"), "path") == [("a.py",), ("b.py",), ("c.py",)]
    assert by(new.read("errors", 1), "path", "kind") == [("a.py", "SyntaxError"), ("b.py", None)]
    with pytest.raises(ValueError, match="is not known"):
        store.Store(spark, folder, at=3).read("errors")


def test_aliases_grow_by_increments(spark):
    """Batches in turn, in one task and by components, equal the fold of all events from the start."""
    from trailhead.operators import alias

    rnd = __import__("random").Random(12)
    events = [(i, f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}", f"c{i}") for i in range(400)]
    kind = "seq long, old_id string, new_id string, commit_hash string"
    want = {o: v for o, v in alias.fold_py([e[1:] for e in events]).items()}
    for one_task in (alias.ONE_TASK, 0):
        old, alias.ONE_TASK = alias.ONE_TASK, one_task
        try:
            table = spark.createDataFrame([], schema.ALIAS)
            for a in (0, 1, 150, 390):
                b = {0: 1, 1: 150, 150: 390, 390: 400}[a]
                table = retrieve.graph.session.checkpointed(alias.record(table, spark.createDataFrame(events[a:b], kind)))
        finally:
            alias.ONE_TASK = old
        assert {r.old_id: (r.new_id, r.root_id, r.commit_hash) for r in table.collect()} == want
    moved = alias.increment(table, spark.createDataFrame([(500, "far", "away", "c")], kind)).collect()
    assert [tuple(r) for r in moved] == [("far", "away", "away", "c")]
    assert alias.increment(table, spark.createDataFrame([], kind)).isEmpty()


def test_a_batch_of_sources_is_read_once(spark):
    """Deleted, empty and whole files are counted from the rows that the parser has written, not by another pass."""
    seen = spark.sparkContext.accumulator(0)
    changes = rows(spark, ("a.py", PY), ("c.cpp", CPP), ("n.txt", b"plain"), ("no.py", b"x = 1\n"), ("gone.py", None), ("void.py", b""))

    def f(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    moved, stats = ingest.changed(empty(spark), changes.mapInArrow(f, changes.schema))
    s = stats.first()
    assert (s.files_processed, s.paths_tombstoned, s.parse_failures) == (6, 2, 0) and seen.value == 6
    assert moved["vectors"].count() == s.nodes_upserted > 0 and seen.value == 6


def test_ids_that_are_renamed_again_and_again_are_few_events(spark, monkeypatch):
    """What needs no order is settled apart, and the rest still equals the fold: of a shape that all files have, of ids that are
    read between their renames or in circles, with equal places, in batches over a stored table."""
    from trailhead.operators import alias

    rnd = __import__("random").Random(4)
    kind = "seq long, old_id string, new_id string, commit_hash string"
    shape = [(i * 2 + j, *((f"sym:a{i}", f"n{i}") if j else (f"hub{i % 2}", f"n{i}")), f"c{i}") for i in range(5, 2000) for j in (0, 1)]
    shape += [(1, "sym:first", "hub0", "c"), (2, "hub1", "early", "c"), (3, "sym:x", "hub1", "c"), (1999, "sym:y", "hub0", "c")]
    rows, moves, left = alias.settled(spark.createDataFrame([], schema.ALIAS), spark.createDataFrame(shape, kind))
    assert left.count() < 12 and rows.count() == moves.count() == 1995
    mixed, one_task = [], alias.ONE_TASK
    for i in range(700):
        old = rnd.choice([f"s{rnd.randrange(150)}", f"h{rnd.randrange(6)}", f"o{rnd.randrange(9)}"])
        new = rnd.choice([f"leaf{rnd.randrange(300)}"] * 6 + [f"h{rnd.randrange(6)}", f"o{rnd.randrange(9)}", f"s{rnd.randrange(150)}"])
        mixed.append((i, old, new, f"c{i}"))
    for events, cuts, every in ((mixed, (0, 40, 350, 360, 700), one_task), (mixed, (0, 300, 700), 0), (shape, (0, 1000, 3994), one_task)):
        events = sorted(events)
        want = alias.fold_py([e[1:] for e in events])
        monkeypatch.setattr(alias, "ONE_TASK", every)
        monkeypatch.setattr(alias, "FEW", 0)
        monkeypatch.setattr(alias, "READS", 7)
        table = spark.createDataFrame([], schema.ALIAS)
        for a, b in zip(cuts, cuts[1:]):
            table = retrieve.graph.session.checkpointed(alias.record(table, spark.createDataFrame(events[a:b], kind)))
        got = table.collect()
        assert len(got) == len(want) and {r.old_id: (r.new_id, r.root_id, r.commit_hash) for r in got} == want
        assert alias.increment(table, spark.createDataFrame([(e[0] + 10**6, *e[1:]) for e in shape[-4:-3]], kind)).count() < 4


CPP2 = rb'''
#define WRAP(x) \
    do { x(); } while (0)
template <typename T, int N = (3 > 2)>
struct Box : public Base<T> {
    Box() : a{1}, b(2), c{f(1), 2} { run(); }
    explicit Box(int x) noexcept(true) : Base<T>(x), a{x} {}
    ~Box() { close(); }
    bool operator==(const Box& o) const { return same(o); }
    int operator()(int i) const { return at(i); }
    Box& operator=(Box&&) = default;
    int size() const& override final { return this->n_(); }
    int value{3};
    std::function<int(int)> g = [](int i) { return hidden(i); };
public:
    auto tail(int a) const -> decltype(a + 1) { return a; }
  private:
    int n = 0;
};
enum class Color : int { Red, Green };
static const int table[] = { first(1), 2 };
extern "C" { int plain(void) { return 0; } }
namespace a::b {
template <class T> T run(T x) requires(sizeof(T) > 1) { return run<int>(x) + ns::go<T>(x); }
std::vector<std::pair<int, int>> pairs(const std::map<int, std::vector<int>>& m) {
    auto f = [&](int a) { return a < 3 && b > (c); };
    Foo x(3), *y = new Foo(4);
    obj.first().second(a->b(), v[i](2)); std::move(x); f(1)(2);
    if (x) return other(R"(} " not code ()", '{', "\"{");
    return {};
}
void free_function(void (*cb)(int), int n) try { cb(n); } catch (...) { report(); }
}
TEST(Foo, Bar) { EXPECT_EQ(check(1), 2); }
int declared(int);
int (*pointer)(int) = nullptr;
'''


def test_functions_of_c_and_cpp():
    got = parse.spans("a.hpp", CPP2)
    want = [
        ("Box", ["run"]), ("Box", []), ("~Box", ["close"]), ("operator==", ["same"]), ("operator()", ["at"]), ("size", ["n_"]), ("tail", []), ("plain", []),
        ("run", ["run", "go"]), ("pairs", ["obj", "obj", "a", "v", "move", "f", "f", "other"]), ("free_function", ["cb"]), ("Foo.Bar", ["EXPECT_EQ", "check"]),
    ]
    assert [(s[2], s[3]) for s in got] == want
    text = [CPP2[s[0] : s[1]] for s in got]
    assert text[0] == b"Box() : a{1}, b(2), c{f(1), 2} { run(); }" and text[8].startswith(b"T run(T x) requires") and all(t.endswith(b"}") for t in text)
    same = parse.spans("a.hpp", CPP2.replace(b"pairs", b"couples").replace(b"other", b"another"))
    assert [s[4] for s in same] == [s[4] for s in got]
    assert parse.spans("b.cpp", CPP2.replace(b"if (x)", b"while (x)"))[9][4] != got[9][4]


def test_broken_c_sources_give_what_can_be_read():
    rnd = __import__("random").Random(1)
    for _ in range(300):
        a, b = sorted(rnd.sample(range(len(CPP2)), 2))
        for s in parse.spans("x.cc", CPP2[:a] + CPP2[b:]):
            assert 0 <= s[0] < s[1] <= len(CPP2)
    assert parse.spans("x.cc", b"") == [] and parse.spans("x.cc", b"}}}) int f() { return g(; }") is not None


def test_a_broken_function_costs_only_itself():
    """Every file of this package with an error in it: all sound functions are found where the whole grammar finds them."""
    import pathlib

    top = pathlib.Path(parse.__file__).parents[1]
    for path in sorted(top.rglob("*.py")):
        source = path.read_bytes()
        want = [(*s, 1.0, None) for s in parse.python_spans(source)]
        for broken in (source + b"\n\ndef lost(a, (:\n    return other(a\n", b"x = = 3\n" + source, source + b'\n\ndef lost(a):\n    """never closed\n'):
            shift = 8 if broken.startswith(b"x =") else 0
            got = parse.spans("a.py", broken)
            assert [(s[0] - shift, s[1] - shift, *s[2:]) for s in got if s[5] == 1.0] == want or not want
            lost = [s for s in got if s[5] == parse.BROKEN]
            if want and b"def lost" in broken:
                assert len(lost) == 1 and lost[0][2] == "lost" and lost[0][6] and broken[lost[0][0] : lost[0][1]].startswith(b"def lost")


def test_islands_of_a_broken_file():
    source = b'''
class A:
    @deco(1)
    def first(self, x=(1,
2)):
        """def inside(): a docstring
def at_the_margin(): too
        """
        return self.f(x)

    def bad(self:
        if x
            return g(h.i(1), while_(2))

    async def third(self):
        def inner():
            return deep()
        return await inner()

def \xc3\xa9t\xc3\xa9(
    a,
):
    # comment at
# the margin
    return a

def tail(): return A()
if = 3
'''
    got = parse.spans("x.py", source)
    assert [(s[2], sorted(s[3]), s[5]) for s in got] == [
        ("first", ["deco", "self"], 1.0), ("bad", ["g", "h", "while_"], parse.BROKEN), ("third", ["deep", "inner"], 1.0), ("été", [], 1.0), ("tail", ["A"], 1.0),
    ]
    text = [source[s[0] : s[1]] for s in got]
    assert text[0].startswith(b"def first") and text[0].endswith(b"return self.f(x)") and text[1].endswith(b"while_(2))") and text[4] == b"def tail(): return A()"
    assert parse.spans("y.py", b"def only(:\n    pass\n")[0][5] == 0.0  # nothing parses: the whole file
    for cut in range(0, len(source), 7):
        for s in parse.spans("z.py", source[:cut] + source[cut + 3 :]):
            assert 0 <= s[0] <= s[1] <= len(source)


def test_a_batch_of_questions_is_as_one_at_a_time(spark):
    """The same contexts and traces, in a number of jobs that does not grow with the questions."""
    t, _ = ingest.apply(empty(spark), rows(spark, ("a.py", PY), ("c.cpp", CPP), ("b.py", b"def audit_log(who, system):\n    return payload(who)\n\ndef other(auth):\n    audit_log(auth)\n")))
    t = {k: retrieve.graph.session.checkpointed(v) for k, v in t.items()}
    fs = spark.createDataFrame([("a.py", PY), ("c.cpp", CPP), ("b.py", b"def audit_log(who, system):\n    return payload(who)\n")], "file_path string, content binary")
    asked = ["How does the auth payload move through the system?", "audit log", "zzzz qqqq", "what is the", None, "add method helper", "payload"]
    counted = []
    for part in (asked[:1], asked):
        group = f"batch-{len(part)}"
        spark.sparkContext.setJobGroup(group, group)
        got = retrieve.build_batch(t, fs, spark.createDataFrame(list(enumerate(part)), "query_id int, question string"), created_at=7)
        requests = {r.query_id: r for r in got.requests.collect()}
        traces = {r.trace_id: r.node_ids for r in got.traces.collect()}
        refused = {r.query_id: r.reason for r in got.refused.collect()}
        counted.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for i, q in enumerate(asked):
        one = retrieve.build(t, fs, q or "", created_at=7)
        if not one.ok:
            assert refused[i] == one.reason and i not in requests
            continue
        r = one.request.first()
        assert (requests[i].traceId, requests[i].context, requests[i].userQuery) == (r.traceId, r.context, q)
        assert traces[one.trace_id] == one.traces.where(F.col("trace_id") == one.trace_id).first().node_ids
    assert set(requests) | set(refused) == set(range(len(asked))) and len(requests) >= 4
    assert counted[1] <= counted[0] + 12, counted


def test_places_in_a_global_order(spark):
    from trailhead.operators import order

    df = spark.range(1000).select((F.col("id") % 10).alias("a"), F.col("id").cast("string").alias("b")).repartition(5)
    got = order.numbered(df, F.col("a"), F.col("b")).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["_rank"])] == sorted((i % 10, str(i)) for i in range(1000))
    assert order.numbered(df.limit(0), F.col("a")).isEmpty()
