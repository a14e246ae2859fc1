"""The pipeline, stage by stage, and the registered queries against SQL."""

from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
import pytest
from compare import difference
from fixtures import documents

from cuemill.llm import queries
from cuemill.llm.common import SESSION, Scratch, shared_dir, staged


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages(spark, sf):
    """Each stage keeps the columns and only some rows of the one before; run() gives the same pieces."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    by_hand = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == by_hand
    assert {r[0] for r in by_hand} == {r.doc_id for r in docs.collect()}


def test_a_stage_called_twice(spark, sf):
    """Calls on the same folder share nothing: both results can be read, in any order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        first = stage(spark, docs, sf)
        second = stage(spark, docs, sf)
        assert first.count() == second.count() == stage(spark, docs, sf).count(), name


def test_two_pipelines_at_once(spark, sf):
    """In two threads, each with a scratch of its own; closing it leaves no file of the call."""

    def run(_):
        with Scratch() as own:
            rows = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect()))
        left = [x._cuemill_path for x in own.tables]
        own.close()
        return rows, left

    with ThreadPoolExecutor(2) as pool:
        (a, left), (b, more) = pool.map(run, range(2))
    assert a == b and left and not set(left) & set(more)
    assert not any(os.path.exists(x.removeprefix("file:")) for x in left + more)


def test_queries_leave_nothing_once_closed(spark, sf):
    SESSION.close()
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    for name, query in queries.QUERIES.items():
        if name in ("op5_suffix_array_dedup", "op8_simhash_near_dedup", "op11_embedding_near_dedup", "op13_conversation_repair"):
            assert query(spark, sf).count() > 0
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) > before
    SESSION.close()
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before


def test_stages_on_odd_rows(spark, sf):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), name)
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_near_stage_drops_similar_texts(spark, sf):
    """A near copy goes from a five-word similarity of 0.8 on, by all pairs; others stay."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        base = text(120)
        rows.append(base)
        for edits in (1, 2, 3, 6, 12):
            near = list(base)
            for k in rng.sample(range(120), edits):
                near[k] = f"e{rng.randrange(5000)}"
            rows.append(near)
    sets = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [i for i in range(len(rows)) if find(i) == i]
    docs = documents(spark, [(i, " ".join(ws), "en", "h") for i, ws in enumerate(rows)])
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf).collect())
    assert got == want and 60 < len(want) < len(rows) - 60
