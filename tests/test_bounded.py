"""Lists cut where the rows lie: the same rows as whole lists, from bounded memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankeval.operators import agent, chunking, dense, heads, literal, tools
from rankeval.plans import catalog, rungs
from rankeval.sources import grams, postings
from rankeval.sources.postings import Postings
from tests.test_postings import corpus, full_ranking


@pytest.mark.parametrize("seed,n,words,chunks", [(5, 50, 30, 3), (6, 30, 5, 2)])
def test_ranks_and_best_chunks_are_those_of_whole_lists(spark, tmp_path, monkeypatch, seed, n, words, chunks):
    docs, queries = corpus(spark, seed, n, words, chunks)
    queries = queries.unionByName(queries.withColumn("query", F.col("query") + 100))  # the same tokens twice
    index = Postings(spark, f"{tmp_path}/i")
    index.extend(docs.select("corpus", "doc").distinct(), lambda new: docs)
    whole = full_ranking(docs, queries, 10_000)
    own = docs.select("corpus", "doc").distinct()
    some = own.where(F.substring("doc", 4, 1) < "4")
    names = {d for _, d in map(tuple, some.collect())}
    homes = {(x.query, x.doc) for x in queries.join(some, "corpus").collect()}
    monkeypatch.setattr(postings, "HELD", 40)  # many blocks
    monkeypatch.setattr(postings, "PRODUCTS", 50)
    got = index.ranks(queries, some)
    assert sorted((x.query, x.doc, x["rank"]) for x in got.collect()) == sorted((q, d, i) for q, d, _, _, i in whole if (q, d) in homes) and names
    wanted = queries.select("query", "corpus").join(own, "corpus")
    assert sorted((x.query, x.doc, x.score + 0.0, x.pos) for x in index.best(queries, wanted).collect()) == sorted(r[:4] for r in whole)
    assert sorted((x.query, x.doc, x.score + 0.0, x.pos, x["rank"]) for x in index.search(queries, 4).collect()) == full_ranking(docs, queries, 4)


def test_hybrid_head_is_that_of_the_whole_lists(spark):
    one = lambda rows, s: spark.createDataFrame(rows, s)
    words = ["red", "green", "blue", "red green", "blue blue", ""]
    t = {
        "files": one([("c", f"f{i:02d}.py", i) for i in range(30)], "corpus string, path string, blob long"),
        "blobs": one([(i, f"def {words[i % 6].replace(' ', '_') or 'x'}():\n    return '{words[i % 5]}'") for i in range(30)], "blob long, text string"),
        "queries": one([(q, "c", words[q % 3]) for q in range(5)], "query long, corpus string, text string"),
        "vectors": one([("c", f"f{i % 12:02d}.py", i // 12, [float(i % 7), float(i % 3)]) for i in range(24)], "corpus string, path string, pos int, embedding array<float>"),
        "query_vectors": one([(q, "c", [1.0, float(q % 2)]) for q in range(5)], "query long, corpus string, query_embedding array<float>"),
    }
    whole = sorted((x.query, x["rank"], x.doc, x.score) for x in rungs.hybrid(t).collect())
    assert sorted((x.query, x["rank"], x.doc, x.score) for x in rungs.hybrid(t, 7).collect()) == [x for x in whole if x[1] <= 7]
    assert len(whole) == 5 * 30


def test_products_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(dense, "CELLS", 64)
    monkeypatch.setattr(heads, "HELD", 20)
    r = np.random.default_rng(3)
    v = r.integers(-3, 4, (90, 4)).astype(float)
    rows = spark.createDataFrame([(i, f"p{i % 7}", i, x.tolist()) for i, x in enumerate(v)], "id long, path string, pos int, embedding array<double>")
    q = rows.where("id < 30").select(F.col("id").alias("query"), F.col("embedding").alias("query_embedding"))
    near = v[:30] @ v.T
    want = sorted((a, int(i), float(near[a, i]), n + 1) for a in range(30) for n, i in enumerate(np.lexsort((np.arange(90), -near[a]))[:5]))
    assert sorted((x.query, x.id, x.score + 0.0, x["rank"]) for x in dense.top_k(rows, q, 5).collect()) == want
    best = sorted((x.query, x.path, x.score + 0.0, x.pos) for x in dense.best_of(rows.select("path", "pos", "embedding"), q).collect())
    assert best == sorted((a, f"p{p}", float(near[a, p::7].max()), int(p + 7 * near[a, p::7].argmax())) for a in range(30) for p in range(7)) and not seen


def test_ladder_queries_ask_for_heads_alone(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a whole list")

    monkeypatch.setattr(Postings, "full", refused)
    for name in ("rung_hybrid", "rung_prompts"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count(), name


def test_few_patterns_make_no_index_and_hits_are_not_ordered_whole(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("an index for a few patterns")

    monkeypatch.setattr(grams, "ready", refused)
    one = lambda rows, s: spark.createDataFrame(rows, s)
    tree = one([("c", f"f{i:02d}.py", i % 4) for i in range(20)] + [("c", "f05.py", 1)] * 2, "corpus string, path string, blob long")
    blobs = one([(i, t) for i, t in enumerate(["needle", "a needle too", "hay", "hay and needle"])] * 2, "blob long, text string")
    got = tools.grep(tree, blobs, one([("r", "c", "needle"), ("s", "c", "hay"), ("t", "c", "none")], "request string, corpus string, pattern string"), limit=5)
    want = []
    for request, held in (("r", (0, 1, 3)), ("s", (2, 3))):
        paths = sorted([f"f{i:02d}.py" for i in range(20) if i % 4 in held] + (["f05.py"] * 2 if 1 in held else []))
        want += [(request, p, len(paths), i < 5) for i, p in enumerate(paths)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert literal.SCANNED < 200  # an evaluation's items go through the index


@pytest.mark.parametrize("cap", [0, 3])
def test_no_more_steps_travel_than_a_replay_can_take(spark, monkeypatch, cap):
    call = lambda name, *paths: {"name": name, "paths": list(paths), "rejected": False, "truncated": False}
    # a retry, the calls, a nudge, and the end
    kinds = [[call(agent.SUBMIT, "absent.py")], *([call("read_file", "a.py")] for _ in range(cap)), [], [call("read_file", "b.py")]]
    long = [("i", n, "", 1.0, 0.1, kinds[n] if n < len(kinds) else [call(agent.SUBMIT, "a.py")]) for n in range(60)]
    steps = spark.createDataFrame(long, agent.STEP_SCHEMA)
    listed = spark.createDataFrame([("i", ["a.py"], "c")], "instance_id string, candidates array<string>, corpus string")
    tree = spark.createDataFrame([("c", "a.py")], "corpus string, path string")
    r = agent.replay(steps, listed, tree, cap=cap).first()
    assert (r.stop, r.steps, r.calls, r.nudges, r.guardrail_retries, r.fell_back) == ("budget_exceeded", cap + 3, cap, 1, 1, True)
    plan = agent.replay(steps, listed, tree, cap=cap)._jdf.queryExecution().optimizedPlan().toString()
    assert f"<= {cap + 3}" in plan


def test_sources_are_dealt_out_before_they_are_parsed(spark):
    blobs = spark.createDataFrame([(i, f"def f{i}(): pass") for i in range(64)], "blob long, text string").coalesce(1)
    assert chunking.definitions(blobs).rdd.getNumPartitions() > 1


def test_an_index_of_pieces_is_neither_sorted_nor_shuffled_by_entry(spark, tmp_path, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("entries are dealt out by range")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", refused)
    for name, n in (("PART", 3), ("ROWS", 4), ("BROADCAST", 7), ("LEAST_CAP", 5)):
        monkeypatch.setattr(grams, name, n)
    r = np.random.default_rng(4)
    texts = {i: "".join(r.choice(list("abc é"), 60)) for i in range(50)}
    asked = [t[10:40] for t in list(texts.values())[:12]] + ["abc", "not to be found here"]
    df = spark.createDataFrame(list(texts.items()), "key long, text string")
    index = grams.Grams(spark, f"{tmp_path}/g")
    assert index.extend(df) == 50
    got = index.search(df, spark.createDataFrame([(x,) for x in asked], "pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, x) for k, t in texts.items() for x in set(asked) if x in t)
    held = index.log.table("entries").collect()
    assert max(len(x.grams) for x in held) == 3 and len({x.key for x in held}) == 50
