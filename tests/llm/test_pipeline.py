import base64
import json
import os
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_dedup import repeats_model
from test_text_operators import hits_model

from trailhead.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, states = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], SF).write.parquet(f"{tmp_path}/{name}")
        states.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "leaks", "tokens"]
    assert all(s.columns == names for s in states[:-1]) and states[-1].columns[: len(names)] == names
    rows = [{r.doc_id: r for r in s.collect()} for s in states]
    # quality: what stays is what scores 0.3 or more, unchanged
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.3}
    assert set(rows[1]) == good and all(rows[1][i] == rows[0][i] for i in good) and len(good) < len(rows[0])
    # near copies: of each class of texts that resemble each other by 0.8, by brute force, the smallest id; unchanged rows
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()}

    sets = {i: shingles(r.text or "") for i, r in rows[1].items()}
    least, moved = {i: i for i in sets}, True
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in links:
            low = min(least[i], least[j])
            moved |= least[i] != least[j]
            least[i] = least[j] = low
    assert set(rows[2]) == set(least.values()) and all(rows[2][i] == rows[1][i] for i in rows[2])
    assert 100 < len(rows[2]) < len(rows[1]) and len(links) > 5
    # repeats
    want = repeats_model([(i, r.text) for i, r in rows[2].items()], 20, True)
    assert {i for i, (n, gone, _) in want.items() if not n or gone < n} == set(rows[3]) and any(gone for _, gone, _ in want.values())
    for i, r in rows[3].items():
        assert b" ".join(r.text.encode().split()) == want[i][2] and r.n_chars == len(r.text)
        assert want[i][1] or r.text == rows[2][i].text
    # leaks
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows[4]) == {i for i, r in rows[3].items() if not hits_model(r.text, items)[1]} and all(rows[4][i] == rows[3][i] for i in rows[4])
    assert 100 < len(rows[4]) < len(rows[3])
    # tokens
    raw = open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb").read()
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    for i, r in rows[5].items():
        assert r.ids == tik.encode_ordinary(rows[4][i].text) and r.n_tokens == len(r.ids)
    assert set(rows[5]) == set(rows[4])
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {i: r.ids for i, r in rows[5].items()}


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.isEmpty()


def test_entry_works_without_the_subpackage(tmp_path):
    """The driver deletes the llm folders and the pipeline: the entry still imports and offers the engine's queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    keep = {"trailhead", "__spark_entry__.py"}
    for p in keep:
        subprocess.run(["cp", "-r", f"{root}/{p}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/trailhead/llm"], check=True)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    queries, sql = json.loads(out.stdout.splitlines()[-1])
    assert queries and all(q.startswith("q_") for q in queries) and set(sql) <= set(queries)
