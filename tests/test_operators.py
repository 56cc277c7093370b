import math
import random

import pytest
from pyspark.sql import functions as F

from rankeval.operators import agent, budget, chunking, dense, evaluate, lexical, literal, ranking, splits, tools
from rankeval.sources import grams

ONE = "corpus string, doc string, tokens array<string>"


def test_bm25_closed_form(spark):
    docs = {"a": ["x", "y", "y"], "b": ["x"], "c": ["z", "w", "w", "v"], "d": ["u"], "e": ["x", "u"]}
    df = spark.createDataFrame([("c", d, t) for d, t in docs.items()], ONE)
    q = spark.createDataFrame([("q", "c", ["y", "x", "x", "none"]), ("empty", "c", [])], "query string, corpus string, tokens array<string>")
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t in {t for x in docs.values() for t in x} for c in [sum(t in x for x in docs.values())]}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    want = {d: round(sum(idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in ["y", "x", "x"] if t in x), 6) for d, x in docs.items() if {"x", "y"} & set(x)}
    scored = lexical.bm25(df, q)
    got = {r.doc: r.score for r in scored.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], abs_tol=2e-6) for d in want)


def test_best_chunk(spark):
    df = spark.createDataFrame([("q", "c", "p", 2, -1.0), ("q", "c", "p", 1, -1.0), ("q", "c", "p", 0, -3.0)], "query string, corpus string, path string, pos int, score double")
    assert [tuple(r) for r in lexical.best_chunk(df).collect()] == [("q", "c", "p", -1.0, 1)]


def test_dense(spark):
    r = random.Random(1)
    v = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [(50, [0.0] * 8), (51, [0.0] * 8)]
    df = spark.createDataFrame(v, "id long, embedding array<float>")
    q = df.where("id in (3, 50)").select(F.col("id").alias("query"), F.col("embedding").alias("query_embedding"))
    top = {(x.query, x["rank"]): x.id for x in dense.top_k(df.repartition(5), q, 4).collect()}
    near = lambda a: sorted(range(52), key=lambda i: (-round(sum(x * y for x, y in zip(a, v[i][1], strict=True)), 6), i))[:4]
    assert [top[3, i] for i in (1, 2, 3, 4)] == near(v[3][1]) and [top[50, i] for i in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert dense.top_k(df, q.limit(0), 4).count() == 0


@pytest.mark.parametrize("ids,kind,asked", [(lambda i: f"v{i:02d}", "string", "int"), (lambda i: i, "int", "string"), (lambda i: i, "long", "long")])
def test_dense_keeps_types_and_leaves_rows_without_a_vector_out(spark, ids, kind, asked):
    v = [(ids(i), [float(i % 3), 1.0]) for i in range(12)] + [(ids(12), None), (None, [9.0, 0.0])]
    df = spark.createDataFrame(v, f"id {kind}, embedding array<float>")
    q = spark.createDataFrame([("7" if asked == "string" else 7, [1.0, 0.0])], f"query {asked}, query_embedding array<double>")
    got = dense.top_k(df, q, 4).orderBy("rank").collect()
    assert [x.id for x in got] == [None, ids(2), ids(5), ids(8)] and dict(dense.top_k(df, q, 4).dtypes)["query"] == q.dtypes[0][1]
    paths = df.select(F.col("id").alias("path"), F.lit(3).alias("pos"), "embedding")
    assert {(x.path, x.score) for x in dense.best_of(paths.where("path is not null"), q).collect()} == {(ids(i), float(i % 3)) for i in range(12)}
    for odd in ([1.0], [1.0, None]):
        with pytest.raises(Exception, match="not 2 numbers long"):
            dense.top_k(spark.createDataFrame([(ids(0), odd)], df.schema), q, 4).collect()


def test_best_vector_within_the_corpus(spark):
    vectors = spark.createDataFrame([("a", "p", 0, [1.0]), ("a", "p", 1, [3.0]), ("b", "p", 0, [5.0]), ("b", "q", 0, [2.0]), ("c", "p", 0, [9.0])], "corpus string, path string, pos int, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0]), (3, "b", [-1.0])], "query int, corpus string, query_embedding array<double>")
    assert sorted(tuple(x) for x in dense.best_of(vectors, queries).collect()) == [(1, "p", 3.0, 1), (2, "p", 5.0, 0), (2, "q", 2.0, 0), (3, "p", -5.0, 0), (3, "q", -2.0, 0)]


def test_index_grows_by_what_is_new(spark):
    tree = spark.createDataFrame([("b1", "x"), ("b2", "x"), ("b1", "y")], "blob string, path string")
    chunks = spark.createDataFrame([("b1", 0, "one two"), ("b2", 0, "three"), ("b2", 1, "four"), ("b3", 0, "five")], "blob string, pos int, text string")
    first = dense.extend_index(tree, None, chunks, dense.hashed_encoder(4)).collect()
    assert sorted((r.blob, r.pos) for r in first) == [("b1", 0), ("b2", 0), ("b2", 1)] and all(math.isclose(sum(x * x for x in r.embedding), 1, rel_tol=1e-5) for r in first)
    again = dense.extend_index(tree, spark.createDataFrame([("b1",)], "blob string"), chunks, dense.hashed_encoder(4)).collect()
    assert {r.blob for r in again} == {"b2"}


def lists(spark, rows):
    return spark.createDataFrame(rows, "query int, list int, rank int, doc string")


def order(df):
    return [r.doc for r in df.orderBy("rank").collect()]


def test_fusion_and_interleaving(spark):
    one = lists(spark, [(1, 0, i + 1, d) for i, d in enumerate("cab")])
    assert order(ranking.rrf(one)) == order(ranking.interleaved(one)) == ["c", "a", "b"]
    two = lists(spark, [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "c"), (1, 1, 2, "b")])
    assert order(ranking.rrf(two)) == ["b", "a", "c"] and order(ranking.interleaved(two)) == ["a", "c", "b"]
    assert ranking.rrf(one.limit(0)).count() == 0


def test_rerank_head_keeps_everything(spark):
    base = spark.createDataFrame([(1, f"d{i}", i) for i in range(1, 8)], "query int, doc string, rank int")
    s = spark.createDataFrame([(1, "d1", 0.1), (1, "d2", 0.9), (1, "d6", 5.0)], "query int, doc string, rescore double")
    assert order(ranking.rerank_head(base, s, 3)) == ["d2", "d1", "d3", "d4", "d5", "d6", "d7"]


def test_measures_of_a_ranking(spark):
    df = spark.createDataFrame([(["./a", "b", "b", "c"], ["a", "c"]), ([], ["a"]), (["x"], [])], "r array<string>, t array<string>")
    got = df.select(ranking.recall_at(F.col("r"), F.col("t"), 1), ranking.recall_at(F.col("r"), F.col("t"), 3), ranking.recall_at(F.col("r"), F.col("t"), 4), ranking.top1(F.col("r"), F.col("t")), ranking.hit_at(F.col("r"), F.col("t"), 4)).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5, 1.0, True, True), (0, 0, 0, False, False), (0, 0, 0, False, False)]


def test_replies_and_answers(spark):
    head = ["pkg/a.py", "pkg/b.py", "pkg/c.py"]
    replies = ["pkg/c.py\n2. pkg/a.py\npkg/c.py\nother/z.py", "no idea", "", "I think pkg/a.py is it"]
    df = spark.createDataFrame([(r, head) for r in replies], "r string, h array<string>").select(ranking.parsed_reply(F.col("r"), F.col("h")).alias("p"))
    got = [(r.p.ranking, r.p.off_list, r.p.unparseable) for r in df.collect()]
    assert got == [(["pkg/c.py", "pkg/a.py", "pkg/b.py"], 1, False), (head, 0, True), (head, 0, True), (head, 1, True)]
    a = spark.createDataFrame([(["./x", "", "x", "b"], ["a", "b"])], "a array<string>, c array<string>")
    assert a.select(ranking.assembled(F.col("a"), F.col("c"))).first()[0] == ["x", "b", "a"]
    c = spark.createDataFrame([([("a", "body"), ("b", None)],)], "c array<struct<path:string,snippet:string>>")
    assert c.select(ranking.rendered_candidates(F.col("c"))).first()[0] == "### a\nbody\n\n### b\n(no snippet available)"


def test_guardrail_and_off_list(spark):
    s = spark.createDataFrame([(1, "c", 0, "./a"), (1, "c", 1, "a"), (1, "c", 2, ""), (1, "c", 3, "zz")], "query int, corpus string, seq int, path string")
    tree = spark.createDataFrame([("c", "a"), ("d", "zz")], "corpus string, path string")
    assert sorted((r.seq, r.path, r.exists) for r in ranking.guardrail(s, tree).collect()) == [(0, "a", True), (3, "zz", False)]
    cand = spark.createDataFrame([(1, "a", 1), (1, "zz", 30)], "query int, path string, rank int")
    sub = s.select("query", "path").where("path in ('a', 'zz')")
    assert ranking.off_list(sub, cand).count() == 0 and [r.path for r in ranking.off_list(sub, cand, 20).collect()] == ["zz"]


def test_scores(spark):
    rows = [(i, "big" if i < 5 else f"s{i}", i % 2 == 0, 1.0, 1.0, float(i), 0.5) for i in range(8)]
    df = spark.createDataFrame(rows, "instance_id int, grp string, hit boolean, recall_3 double, recall_5 double, latency double, cost double")
    o = evaluate.overall(df).first()
    assert (o.n, o.top_1, o.latency_median, o.cost_total) == (8, 0.5, 4.0, 4.0)
    g = {r.grp: r.n for r in evaluate.by_group(df, "grp").collect()}
    assert g == {"big": 5, "other": 3} and {r.grp: r.n for r in evaluate.report(df, "grp").collect()} == g | {None: 8}
    none = evaluate.overall(df.limit(0)).first()
    assert (none.n, none.top_1, none.ci_low, none.ci_high, none.cost_each) == (0, 0, 0, 0, 0)


def test_runs_that_do_not_match_are_refused(spark):
    a = spark.createDataFrame([("x", True), ("y", False)], "instance_id string, hit boolean")
    b = spark.createDataFrame([("x", False), ("z", True)], "instance_id string, hit boolean")
    with pytest.raises(evaluate.UnknownRows):
        evaluate.matched(a, b)
    with pytest.raises(evaluate.UnknownRows):
        evaluate.matched(a.limit(0), a.limit(0))
    with pytest.raises(evaluate.UnknownRows, match="z"):
        evaluate.joined(b, a)
    c = evaluate.compared(evaluate.matched(a, a.withColumn("hit", F.lit(True)))).withColumn("verdict", evaluate.verdict()).first()
    assert (c.n, c.both_hit, c.a_only, c.b_only, c.delta, c.p_value, c.verdict) == (2, 1, 0, 1, 0.5, 1.0, "nothing established")
    assert evaluate.last_per_key(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, s int, v string"), "k", "s").collect()[0].v == "b"


@pytest.mark.parametrize("target", [0, 7, 50, 100, 500])
def test_largest_remainder(spark, target):
    n = {"a": 40, "b": 33, "c": 20, "d": 6, "e": 1}
    pool = sum(n.values())
    exact = {g: target * c / pool for g, c in n.items()}
    want = {g: min(c, int(exact[g])) for g, c in n.items()}
    spare = target - sum(want.values())
    for g in sorted(n, key=lambda g: (-((target * n[g]) % pool), g)):
        if spare > 0 and want[g] < n[g]:
            want[g] += 1
            spare -= 1
    df = spark.createDataFrame(list(n.items()), "group string, n long")
    assert {r.group: r.quota for r in splits.largest_remainder(df, target).collect()} == want
    assert splits.largest_remainder(df.limit(0), target).count() == 0


def test_splits(spark):
    rows = spark.createDataFrame([(f"i{i}", f"g{i % 3}") for i in range(20)] + [("solo", "one")], "instance_id string, group string")
    for make in (splits.stratified, splits.shuffled):
        got = make(rows, 7)
        again = {r.instance_id: r.side for r in make(rows.orderBy(F.rand(1)), 7).collect()}
        assert {r.instance_id: r.side for r in got.collect()} == again and len(again) == 21 and again["solo"] == "test"
        assert got.where("side = 'dev'").groupBy("group").count().agg(F.sum("count")).first()[0] in (9, 10, 11)
    quota = splits.largest_remainder(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")), 5)
    split = splits.stratified(rows, 7)
    ci = splits.ci_slice(split, quota)
    assert ci.count() <= 5
    sides = split.select("instance_id", "side").union(ci.select("instance_id", F.lit("ci")))
    splits.check(sides)
    with pytest.raises(splits.SplitError):
        splits.check(sides.union(spark.createDataFrame([("ghost", "ci")], "instance_id string, side string")))
    ordered = splits.select_side(rows, split.withColumn("ord", F.col("pos")), "dev")
    assert [r.ord for r in ordered.collect()] == sorted(r.ord for r in ordered.collect())


SOURCE = '''"""Doc."""
import os

class A(Base, Other):
    """Class doc."""
    x = 1

    @staticmethod
    def f(a, *b, c=1) -> int:
        """F doc."""
        def inner():
            return 2
        return 1

    async def g(self):
        pass

if os:
    def hidden():
        pass
'''


def test_literal_hits(spark):
    texts = [("a", "one two three"), ("b", "twotwo"), ("c", None), ("d", ""), ("e", "x" * 100000 + "%_"), ("b", "twotwo")]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts], "blob string, text string, pattern string")
    asked = ["two", "one two three", "", None, "%_", "x" * 90_000 + "%", "none of it here", "two"]
    p = spark.createDataFrame([(x,) for x in asked], "pattern string")
    want = sorted((k, x) for k, t in texts for x in {y for y in asked if y is not None} if t is not None and x in t)
    assert sorted(map(tuple, literal.literal_hits(df, p, key="blob").collect())) == want
    assert literal.literal_hits(df, p.limit(0), key="blob").count() == 0 and literal.literal_hits(df.limit(0), p, key="blob").count() == 0


@pytest.mark.parametrize("seed,cap", [(1, 64), (2, 2), (3, 0)])
def test_literal_index_against_brute_force(spark, tmp_path, monkeypatch, seed, cap):
    monkeypatch.setattr(grams, "LEAST_CAP", cap)
    monkeypatch.setattr(grams, "SLICE_CHARS", 40)
    r = random.Random(seed)
    piece = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    shared = [piece(12) for _ in range(5)]
    texts = {i: r.choice(shared) + piece(r.randrange(0, 80)) + r.choice(shared) for i in range(150)}
    asked = {t[a : a + r.randrange(0, 30)] for t in r.sample(list(texts.values()), 25) for a in [r.randrange(len(t))]} | {piece(9), piece(3), *shared}
    df = spark.createDataFrame(list(texts.items()), "key long, text string")
    p = spark.createDataFrame([(x,) for x in asked], "pattern string")
    index = grams.Grams(spark, f"{tmp_path}/g")
    assert [index.extend(x) for x in (df.where("key < 60"), df, df)] == [60, 90, 0]
    want = sorted((k, x) for k, t in texts.items() for x in asked if x in t)
    assert sorted(map(tuple, index.search(df, p).collect())) == want
    pairs, blind = index.candidates(p)
    blind = {(x.part, x.pattern) for x in blind.collect()}
    assert {x for _, x in blind} >= {x for x in asked if len(x.encode()) < grams.PIECE + grams.WINDOW - 1}
    may = {(x.key, x.pattern) for x in pairs.collect()}
    assert may | {(k, x) for k in texts for x in asked if (int(k >= 60), x) in blind} >= set(want)
    if cap == 64:
        assert len(may) < 3 * len(want) + 20 and not {x for _, x in blind if len(x) > 20}


def test_best_vector_of_each_path(spark):
    r = random.Random(5)
    v = [(f"p{i % 7}", i, [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(60)]
    q = [(n, [float(r.randrange(-2, 3)) for _ in range(3)]) for n in range(5)]
    vectors = spark.createDataFrame(v, "path string, pos long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame(q, "query long, query_embedding array<double>")
    want = {}
    for n, x in q:
        for path, pos, y in v:
            score = sum(a * b for a, b in zip(x, y, strict=True))
            want[n, path] = max(want.get((n, path), (-99.0, 0)), (score, -pos))
    got = {(b.query, b.path): (b.score, -b.pos) for b in dense.best_of(vectors, queries).collect()}
    assert got == want and dense.best_of(vectors, queries.limit(0)).count() == 0


def test_chunks(spark):
    names = [c.name for c in chunking.chunks_of(SOURCE)]
    assert names == ["A", "A.f", "A.f.inner", "A.g"]
    a, f = chunking.chunks_of(SOURCE, bodies=True)[:2]
    assert a.signature == "class A(Base, Other)" and "return 1" not in a.content and "@staticmethod" in a.content and a.kind == "class"
    assert f.signature == "def A.f(a, *b, c=1) -> int" and "return 2" not in f.content and f.docstring == "F doc." and f.line == 9
    for text in ("print 'x'", "x = 1\n", "", "a\0b"):
        only = chunking.chunks_of(text)
        assert [c.kind for c in only] == ["file"] and only[0].content == text and not chunking.definitions_of(text)
    long = chunking.chunks_of("x = 1\n" * 1000)
    assert [c.name for c in long] == [f"#{i}" for i in range(len(long))] and "".join(c.content for c in long) == "x = 1\n" * 1000 and all(len(c.content) <= 2048 for c in long)
    blobs = spark.createDataFrame([("b", SOURCE), ("n", None)], "blob string, text string")
    assert chunking.chunked(blobs).count() == 5 and chunking.definitions(blobs).count() == 4
    out = tools.outline(blobs.withColumnRenamed("blob", "path").where("path = 'b'")).first()
    assert out.n == 4 and out.body.split("\n")[0] == "     4  class A(Base, Other)"


def test_windows_in_both_forms(spark):
    r = random.Random(3)
    texts = ["", "a" * 25, "ab\n" * 10] + ["".join(r.choice(["aaaa", "b", "\n", "ccccccccccccc"]) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.w for x in df.select("i", chunking.line_windows("t", 10).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == chunking.windows(t, 10), t
        assert "".join(got[i]) == t and all(len(w) <= 10 for w in got[i])


def test_budgets(spark):
    r = random.Random(2)
    rows = [(i, r.random(), r.random() < 0.3, r.random() < 0.5, 1.0) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "seq long, cost double, cached boolean, hit boolean, latency double")
    spent, calls, first = 0.0, 0, None
    for i, cost, cached, *_ in rows:
        if first is None and calls and round(spent + spent / calls, 6) > 10:
            first = i
        spent, calls = (spent, calls) if cached else (spent + cost, calls + 1)
    gate = budget.projected_gate(df, 10.0)
    assert gate.where("refused").agg(F.min("seq")).first()[0] == first
    total = budget.running(df, {"s": F.col("cost")}, width=7)
    assert all(math.isclose(x.s, sum(c for j, c, *_ in rows if j <= x.seq)) for x in total.collect())
    p = budget.progress(df.where("seq <= 25")).orderBy("seq").collect()
    assert [x.seq for x in p] == [10, 20, 25] and p[-1].hits == sum(h for *_, h, _ in rows[:25])
    assert budget.spent_gate(df, 0.0).where("refused").count() == 100


def step(calls=(), cost=0.1, seconds=1.0, text=""):
    return {"text": text, "cost": cost, "seconds": seconds, "calls": [{"name": n, "paths": list(p), "rejected": False, "truncated": False} for n, p in calls]}


def run(steps, candidates=("a", "b"), there=("a", "b", "z"), **how):
    it = agent.Replay(list(candidates), set(there).__contains__, **how)
    for s in steps if candidates else ():
        if not it.feed(s):
            break
    return it.result()


def test_agent_states():
    submit = lambda *p: step([(agent.SUBMIT, p)])
    look = lambda *p: step([("read_file", p)])
    done = run([look("z"), submit("./z", "b", "z")])
    assert (done["stop"], done["ranking"], done["off_list"], done["recalled"], done["credited"], done["calls"]) == ("answered", ["z", "b", "a"], ["z"], [], "read_file", 1)
    retry = run([submit("ghost", "b"), submit("ghost", "z")])
    assert (retry["ranking"], retry["guardrail_retries"], retry["hallucinated"], retry["recalled"]) == (["z", "a", "b"], 1, ["ghost", "ghost"], ["z"])
    assert run([], candidates=())["stop"] == "no_candidates"
    late = run([look("a"), submit("b")], timeout=0.5)
    assert late["stop"] == "timeout" and late["steps"] == 1 and late["fell_back"]
    greedy = run([look("a")] * 5, cap=2)
    assert (greedy["stop"], greedy["calls"], greedy["nudges"], greedy["ranking"]) == ("budget_exceeded", 2, 1, ["a", "b"])
    silent = run([step(), step()])
    assert (silent["stop"], silent["no_answer"], silent["nudges"]) == ("answered", 1, 1)
    batch = run([step([("read_file", ["a"])] * 5), submit("b")], cap=3)
    assert batch["calls"] == 3 and batch["ranking"] == ["b", "a"]
    both = run([step([("read_file", ["a"]), (agent.SUBMIT, ["b"])])])
    assert both["calls"] == 0 and both["ranking"] == ["b", "a"]
    assert run([step([("nope", ["a"])]), submit("a")])["unknown_tools"] == 1


def test_agent_replay_as_rows(spark):
    rows = [("i1", 0, "", 0.5, 1.0, [("search_code", ["p/z.py"], False, True)]), ("i1", 1, "", 0.5, 1.0, [(agent.SUBMIT, ["p/z.py", "no.py"], False, False)]), ("i1", 2, "", 0.5, 1.0, [(agent.SUBMIT, ["p/z.py"], False, False)]), ("i2", 0, "", 0.1, 1.0, None)]
    steps = spark.createDataFrame(rows, agent.STEP_SCHEMA)
    cand = spark.createDataFrame([("i1", ["a.py"], "c"), ("i2", ["b.py"], "c"), ("i3", [], "c"), ("i4", ["d.py"], "c")], "instance_id string, candidates array<string>, corpus string")
    tree = spark.createDataFrame([("c", "p/z.py"), ("c", "a.py")], "corpus string, path string")
    got = {r.instance_id: r for r in agent.replay(steps, cand, tree).collect()}
    assert got["i1"].ranking == ["p/z.py", "a.py"] and got["i1"].surfaced == {"p/z.py": "search_code"} and got["i1"].truncated == 1 and got["i1"].guardrail_retries == 1
    assert got["i2"].ranking == ["b.py"] and got["i2"].fell_back and got["i3"].stop == "no_candidates" and got["i4"].steps == 0
    c = agent.counters(agent.replay(steps, cand, tree)).first()
    assert (c.no_candidates, c.fell_back, c.off_list, c.hallucinated, c.calls) == (1, 2, 1, 1, 1)
    stats = agent.call_stats(agent.replay(steps, cand, tree), 1).first()
    assert (stats["median"], stats["mean"], stats.at_cap) == (0, 0.3, 1)
    assert agent.call_stats(agent.replay(steps, cand, tree), 0).first().at_cap == 0


def test_tools(spark):
    tree = spark.createDataFrame([("c", "pkg/a.py", "1"), ("c", "docs/a.py", "1"), ("c", "pkg/b.py", "2"), ("c", "pkg/bin.py", "3")], "corpus string, path string, blob string")
    blobs = spark.createDataFrame([("1", "class W:\n    def build(self): pass\n"), ("2", "x = W.build\n"), ("3", "W.build\0")], "blob string, text string")
    ask = spark.createDataFrame([("r1", "c", "build"), ("r2", "c", "a.c"), ("r3", "c", "W:")], "request string, corpus string, pattern string")
    got = sorted((r.request, r.path, r.hits, r.shown) for r in tools.grep(tree, blobs, ask).collect())
    assert got == [("r1", "pkg/a.py", 2, True), ("r1", "pkg/b.py", 2, True), ("r3", "pkg/a.py", 1, True)]
    found = tools.find_definition(tree, blobs, ask.select("request", "corpus", F.lit("W.build").alias("symbol")).limit(1)).collect()
    assert [(r.path, r.line) for r in found] == [("pkg/a.py", 2)]
    files = spark.createDataFrame([("c", "f", "l1\nl2\nl3\n")], "corpus string, path string, text string")
    want = spark.createDataFrame([(1, "c", "./f", 2, 9), (2, "c", "f", 4, 9), (3, "c", "g", 1, 2), (4, "c", "f", 3, 1), (5, "c", "f", 0, 1)], "request int, corpus string, path string, first int, last int")
    got = {r.request: r for r in tools.read_range(want, files).collect()}
    assert got[1].body == "     2  l2\n     3  l3" and got[1].lines == 3 and not got[1].rejected and all(got[i].rejected for i in (2, 3, 4, 5))
    long = spark.createDataFrame([("c", "f", "x\n" * 999_999 + "million\nand one"), ("c", "g", "a\x0cb\u2028c\r\nd\x85")], files.schema)
    ask = spark.createDataFrame([(1, "c", "f", 999_999, 1_000_001), (2, "c", "g", 1, 9)], want.schema)
    got = {r.request: r for r in tools.read_range(ask, long).collect()}
    assert got[1].body == "999999  x\n1000000  million\n1000001  and one" and got[1].lines == 1_000_001
    assert got[2].body == "     1  a\n     2  b\n     3  c\n     4  d" and got[2].lines == 4
    cut = {r.request: r for r in tools.read_range(want, files, max_lines=1).collect()}
    assert cut[1].body == "     2  l2" and cut[1].truncated


def test_one_prediction_is_scored_for_its_own_instance(spark):
    p = "struct<instance_id:string,ranked_files:array<string>,latency:double,cost:double,stop:string>"
    i = "struct<instance_id:string,grp:string,truth:array<string>>"
    pair = lambda a, b, ranked, truth: spark.createDataFrame([((a, ranked, 1.0, 0.5, "answered"), (b, "g", truth))], f"p {p}, i {i}").select(evaluate.score_one(F.col("p"), F.col("i")).alias("s")).first().s
    s = pair("x", "x", ["./b.py", "a.py", "c.py", "d.py"], ["b.py", "d.py"])
    assert (s.instance_id, s.grp, s.hit, s.recall_3, s.recall_5, s.stop) == ("x", "g", True, 0.5, 1.0, "answered")
    assert (s := pair("x", "x", [], ["b.py"])).hit is False and s.recall_5 == 0 and pair("x", "x", ["b.py"], []).recall_3 == 0
    for a, b in (("x", "y"), (None, "y"), ("x", None)):
        with pytest.raises(Exception, match="prediction of"):
            pair(a, b, ["b.py"], ["b.py"])
    rows = spark.createDataFrame([("x", ["b.py"], 1.0, 0.5, "answered"), ("z", ["b.py"], 1.0, 0.5, "answered")], "instance_id string, ranked_files array<string>, latency double, cost double, stop string")
    truth = spark.createDataFrame([("x", "g", ["b.py"]), ("y", "g", ["b.py"])], "instance_id string, grp string, truth array<string>")
    assert evaluate.scores(rows.where("instance_id = 'x'"), truth).count() == 1 and evaluate.scores(rows.limit(0), truth).count() == 0
    with pytest.raises(evaluate.UnknownRows, match="z"):
        evaluate.scores(rows, truth)


def test_prompts_take_values_as_they_are(spark):
    head = spark.createDataFrame([("q", "b.py", 2, None), ("q", "a.py", 1, "def {issue}(): ..."), ("q", "c.py", 3, ""), ("r", "a.py", 1, "x")], "query string, doc string, rank int, snippet string")
    issues = spark.createDataFrame([("q", "broken {candidates} {n}"), ("r", None), ("none", "x")], "query string, issue string")
    got = {r.query: (r.n, r.prompt) for r in ranking.prompts(head, issues, "{n}: {issue}\n{candidates}|{calls}", 2, calls=F.lit(3)).collect()}
    assert got == {"q": (2, "2: broken {candidates} {n}\n### a.py\ndef {issue}(): ...\n\n### b.py\n(no snippet available)|3"), "r": (1, "1: \n### a.py\nx|3")}
    with pytest.raises(ValueError, match="calls"):
        ranking.prompts(head, issues, ranking.AGENT_TEMPLATE)


def test_tools_answer_by_name(spark):
    tree = spark.createDataFrame([("c", "a.py", "1"), ("c", "b/x.py", "2"), ("c", "lost.py", "3"), ("d", "a.py", "2")], "corpus string, path string, blob string")
    blobs = spark.createDataFrame([("1", "class A:\n    def run(self):\n        return go()\n"), ("2", "def go():\n    pass\n")], "blob string, text string")
    kind = "request string, corpus string, tool string, path string, first int, last int, pattern string"
    asked = [
        ("r1", "c", "read_file", "./a.py", 2, 3, None), ("r2", "c", "read_file", "none.py", 1, 2, None), ("r3", "c", "read_file", "a.py", 9, 10, None), ("s1", "c", "search_code", None, None, None, "go()"), ("s2", "c", "search_code", None, None, None, "absent thing"),
        ("s3", "c", "search_code", None, None, None, ""), ("s4", "d", "search_code", None, None, None, "go()"), ("o1", "c", "file_outline", "a.py", None, None, None), ("o2", "c", "file_outline", "no.py", None, None, None), ("o3", "d", "file_outline", "a.py", None, None, None),
        ("d1", "c", "find_definition", None, None, None, "A.run"), ("d2", "c", "find_definition", None, None, None, "none"), ("u1", "c", "rm", None, None, None, None), ("u2", "c", None, None, None, None, None),
    ]
    got = {r.request: (r.text, r.paths, r.truncated, r.rejected) for r in tools.answers(spark.createDataFrame(asked, kind), tree, blobs).collect()}
    assert len(got) == len(asked)
    assert got["r1"] == ("     2      def run(self):\n     3          return go()", ["a.py"], False, False)
    assert got["s1"] == ("a.py\nb/x.py", ["a.py", "b/x.py"], False, False) and got["s4"][1] == ["a.py"] and got["s2"] == ("no match", [], False, False)
    assert got["o1"][0].startswith("     1  class A") and got["o1"][1] == ["a.py"] and "go" in got["o3"][0]
    assert got["d1"][1] == ["a.py"] and got["d1"][0].startswith("a.py:2  ") and got["d2"] == ("no definition", [], False, False)
    assert {k for k, v in got.items() if v[3]} == {"r2", "r3", "s3", "o2", "u1", "u2"}
    with pytest.raises(Exception, match="content is missing: lost.py"):
        tools.answers(spark.createDataFrame([("x", "c", "read_file", "lost.py", 1, 1, None)], kind), tree, blobs).collect()
