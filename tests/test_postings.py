import random

import pytest
from pyspark.sql import functions as F

from rankeval.operators import lexical
from rankeval.plans import catalog, rungs
from rankeval.sources.chunks import Chunks
from rankeval.sources.postings import Postings
from rankeval.sources.store import Conflict, Log


def corpus(spark, seed, n, words, chunks):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % words}" for _ in range(40 * n)]
    rows = [(r.choice("xy"), f"d{i:03d}", p, [r.choice(vocabulary) for _ in range(r.randrange(0, 30))]) for i in range(n) for p in range(r.randrange(1, chunks + 1))]
    asked = [(q, r.choice("xy"), [r.choice(vocabulary) for _ in range(r.randrange(0, 6))]) for q in range(12)]
    return spark.createDataFrame(rows, "corpus string, doc string, pos int, tokens array<string>"), spark.createDataFrame(asked, "query int, corpus string, tokens array<string>")


def full_ranking(docs, queries, k):
    """By the scores of all chunks, matched or not."""
    scored = lexical.bm25(docs.select("corpus", F.struct("doc", "pos").alias("doc"), "tokens"), queries)
    every = queries.select("query", "corpus").join(docs.select("corpus", F.struct("doc", "pos").alias("doc")), "corpus").join(scored, ["query", "corpus", "doc"], "left")
    out = {}
    for x in every.collect():
        own = out.setdefault(x.query, {})
        mine = (-(x.score or 0.0), x.doc.pos)
        own[x.doc.doc] = min(own.get(x.doc.doc, mine), mine)
    return sorted((q, d, -s + 0.0, p, i) for q, own in out.items() for i, (d, (s, p)) in enumerate(sorted(own.items(), key=lambda e: (e[1][0], e[0]))[:k], 1))


@pytest.mark.parametrize("seed,n,words,chunks,k", [(1, 60, 400, 1, 5), (2, 80, 40, 3, 10), (3, 40, 5, 2, 3), (4, 6, 200, 2, 10)])
def test_search_is_the_full_ranking(spark, tmp_path, seed, n, words, chunks, k):
    docs, queries = corpus(spark, seed, n, words, chunks)
    index = Postings(spark, f"{tmp_path}/i")
    parts = [docs.where("doc < 'd020'"), docs, docs]  # the second adds what the first lacks, the third nothing
    added = [index.extend(d.select("corpus", "doc").distinct(), lambda new, d=d: d.join(new, ["corpus", "doc"], "left_semi")) for d in parts]
    assert added[0] + added[1] == docs.count() and added[2] == 0
    got = index.search(queries, k)
    assert sorted((x.query, x.doc, x.score + 0.0, x.pos, x["rank"]) for x in got.collect()) == full_ranking(docs, queries, k)
    whole = Postings(spark, f"{tmp_path}/whole")
    whole.extend(docs.select("corpus", "doc").distinct(), lambda new: docs)
    scores = lambda i: sorted(map(tuple, i.full(queries).collect()))
    assert scores(index) == scores(whole)


def test_search_sums_fewer_pairs_and_reads_no_text(spark, tmp_path):
    r = random.Random(9)
    rows = [("c", i, 0, ["common"] * r.randrange(1, 4) + [f"r{r.randrange(300)}" for _ in range(20)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "corpus string, doc long, pos int, tokens array<string>")
    queries = spark.createDataFrame([(q, "c", ["common", f"r{q}", f"r{q + 1}", f"r{q + 2}"]) for q in range(5)], "query int, corpus string, tokens array<string>")
    index = Postings(spark, f"{tmp_path}/i")
    index.extend(docs, lambda new: new)
    all_pairs, summed = index.full(queries).count(), index.candidates(queries, 10).count()
    assert all_pairs == 5 * 3000 and summed < all_pairs / 4
    got = index.search(queries, 10)
    assert sorted((x.query, x.doc, x.score, x.pos, x["rank"]) for x in got.collect()) == full_ranking(docs, queries, 10)
    assert "tokens" not in got._jdf.queryExecution().toString()


def test_log_shows_whole_parts_alone(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/t")
    assert log.entries() == [] and log.table("x") is None
    left = log.new_folder()
    log.write(spark.range(3), left, "x")  # a writer that died before its commit
    assert log.table("x") is None
    first, second = log.new_folder(), log.new_folder()
    for i, f in enumerate((first, second)):
        log.write(spark.range(i + 1), f, "x")
    log.commit(first, 0, rows=1)
    with pytest.raises(Conflict):
        log.commit(second, 0)
    assert log.table("x").count() == 1 and log.entries()[0]["rows"] == 1
    log.commit(second, 1)
    assert log.table("x").count() == 3 and [e["number"] for e in log.entries()] == [0, 1]


def test_two_writers_do_not_double_documents(spark, tmp_path):
    docs = spark.createDataFrame([("c", "a", 0, ["x"])], "corpus string, doc string, pos int, tokens array<string>")
    one, two = Postings(spark, f"{tmp_path}/i"), Postings(spark, f"{tmp_path}/i")

    def late(new):
        two.extend(docs, lambda n: n)  # the other one is done first
        return new

    with pytest.raises(Conflict):
        one.extend(docs, late)
    assert one.docs().count() == 1 and one.extend(docs, lambda n: n) == 0


def test_a_blob_is_parsed_once_in_all_commits(spark, tmp_path):
    blobs = spark.createDataFrame([("b1", "def f(): pass"), ("b2", "class A:\n    def g(self): return 1"), ("b3", "x = ("), ("b4", "")], "blob string, text string")
    files = lambda rows: spark.createDataFrame(rows, "corpus string, path string, blob string")
    first, second = [("r@1", "a.py", "b1"), ("r@1", "b.py", "b2"), ("r@1", "c.py", "b1")], [("r@2", "a.py", "b1"), ("r@2", "b.py", "b3"), ("r@2", "d.py", "b4")]
    held = Chunks(spark, f"{tmp_path}/c", bodies=True)
    assert [held.extend(files(x), blobs) for x in (first, first + second, second)] == [2, 2, 0]
    assert sorted((x.blob, x.name) for x in held.rows().collect()) == [("b1", "f"), ("b2", "A"), ("b2", "A.g"), ("b3", ""), ("b4", "")]
    t = {"store": f"{tmp_path}/ladder", "files": files(first), "blobs": blobs, "queries": spark.createDataFrame([("q", "r@1", "where is g"), ("p", "r@2", "f")], "query string, corpus string, text string")}
    assert {(x.query, x.doc) for x in rungs.bm25_chunks_bodies(t).collect()} == {("q", p) for p in ("a.py", "b.py", "c.py")}
    both = rungs.bm25_chunks_bodies(t | {"files": files(first + second)})
    assert {(x.query, x.doc) for x in both.collect()} == {("q", p) for p in ("a.py", "b.py", "c.py")} | {("p", p) for p in ("a.py", "b.py", "d.py")}
    assert [e["blobs"] for e in Chunks(spark, f"{tmp_path}/ladder/chunks", bodies=True).log.entries()] == [2, 2]
    for rung in (rungs.bm25, rungs.bm25_chunks, rungs.bm25_chunks_bodies):
        whole = sorted((x.query, x["rank"], x.doc, x.score) for x in rung(t).collect())
        assert sorted((x.query, x["rank"], x.doc, x.score) for x in rung(t, 2).collect()) == [x for x in whole if x[1] <= 2]


def test_rungs_read_no_text(spark):
    plan = lambda name: catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for name in ("bm25_topk", "bm25_chunks", "rung_bm25", "rung_bm25_chunks_bodies"):
        p = plan(name)
        assert "p_type" not in p and "text:string" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        assert "MapInPandas" not in p and "MapInArrow" not in p and p.count("Scan parquet") <= 3, name
    fused = plan("rung_hybrid")  # both lists whole, so each query has a row for each file; vectors are scanned once
    assert "p_type" not in fused and "MapInPandas" not in fused and fused.count("MapInArrow") == 1
