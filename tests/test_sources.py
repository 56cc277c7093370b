import random
import re
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from rankeval.operators import agent, splits
from rankeval.operators.dense import hashed_encoder
from rankeval.plans import report, rungs
from rankeval.sources import cache, dataset, index, remote, runs, split_file, tree
from rankeval.streaming import incremental

PROVENANCE = runs.Provenance("abc-dirty", "d", "rev", "dev", 7, "run it", "2026-01-01")


def predictions(spark, rows):
    return spark.createDataFrame(rows, runs.PREDICTION)


def test_runs_round_trip(spark, tmp_path):
    df = predictions(spark, [("i1", "bm25", ["a", "b"], "answered", 1.0, 0.0, None), ("i2", "bm25", [], "no_candidates", 1.0, 0.0, 0.5)])
    path = runs.run_path(spark, str(tmp_path), "bm25/x", "dev", "2026-01-01", "abc")
    header = runs.Header("bm25", "dev", 2, PROVENANCE)
    runs.write_run(df, path, header)
    got, rows = runs.read_run(spark, path)
    assert got == header and got.provenance.is_dirty and got.comparable and sorted(rows.collect()) == sorted(df.collect())
    assert runs.run_path(spark, str(tmp_path), "bm25/x", "dev", "2026-01-01", "abc") == f"{path}-2"
    runs.write_run(df, f"{path}-short", runs.Header("bm25", "dev", 3, PROVENANCE, limit=3))
    with pytest.raises(runs.RunError, match="2 of 3"):
        runs.read_run(spark, f"{path}-short")
    with pytest.raises(runs.RunError, match="header"):
        runs.read_run(spark, str(tmp_path / "none"))
    with pytest.raises(runs.RunError):
        runs.comparable(header, runs.Header("bm25", "test", 2, PROVENANCE))


@pytest.mark.parametrize("row", [("i", "r", ["a", "a"], "answered", 0.0, 0.0, None), ("i", "r", [], "answered", 0.0, 0.0, None), ("i", "r", ["a"], "what", 0.0, 0.0, None)])
def test_broken_predictions_are_refused(spark, row):
    with pytest.raises(Exception, match=r"repeated path|without a ranking|unknown stop"):
        runs.checked(predictions(spark, [row])).collect()


#: What each commit of the shop's repository writes (None: deletes).
HISTORY = [
    {"shop/stock.py": "LEVEL = 3\n", "shop/cart.py": "class Cart: ...\n", "spec/cart_test.py": "check\n", "notes.txt": "to do\n"},
    {"shop/audit.py": "TRAIL = []\n", "shop/cart.py": "def refund(): ...\n"},
    {"notes.txt": None, "shop/stock.py": None},
]


@pytest.fixture(scope="module")
def clone(tmp_path_factory):
    """(folder of clones, its commits): one import stream makes the whole history."""
    root, stream = tmp_path_factory.mktemp("clones"), []
    for n, files in enumerate(HISTORY, 1):
        stream.append(f"commit refs/heads/main\nmark :{n}\ncommitter t <t@t> {n} +0000\ndata 1\nx\n" + (f"from :{n - 1}\n" if n > 1 else ""))
        stream += [f"D {path}\n" if body is None else f"M 100644 inline {path}\ndata {len(body)}\n{body}\n" for path, body in files.items()]
    repo = str(root / "own__name")
    subprocess.run(["git", "init", "-q", "-b", "main", repo], check=True)
    subprocess.run(["git", "-C", repo, "fast-import", "--quiet"], input="".join(stream).encode(), check=True)
    log = subprocess.run(["git", "-C", repo, "rev-list", "--reverse", "main"], check=True, capture_output=True, text=True)
    return root, log.stdout.split()


def test_git_trees(spark, clone):
    root, pins = clone
    tree.register(spark)
    load = lambda kind, pin: spark.read.format(kind).option("root", str(root)).option("pins", f"own/name@{pin}").load()
    first = load("git_tree", pins[0])
    assert {r.path for r in tree.source_files(first).collect()} == {"shop/cart.py", "shop/stock.py"}
    assert load("git_tree", pins[1]).count() == 5
    both = spark.read.format("git_blobs").option("root", str(root)).option("pins", f"own/name@{pins[0]},own/name@{pins[1]}").load().select("blob", "text").distinct()
    texts = {r.text for r in tree.wanted_blobs(first, both).collect()}
    assert texts == {"class Cart: ...\n", "LEVEL = 3\n", "check\n", "to do\n"}
    with pytest.raises(tree.CommitUnavailable):
        tree.git(str(root / "own__name"), "cat-file", "-p", "f" * 40)
    assert load("git_tree", pins[2]).count() == 3
    assert tree.code_version(str(root / "own__name")) and tree.code_version("/") == "unknown"
    files = tree.source_files(load("git_tree", pins[1])).select(F.lit("own").alias("corpus"), "path", "blob")
    q = spark.createDataFrame([("q", "own", "refund call fails in shop/cart.py")], "query string, corpus string, text string")
    t = {"files": files, "blobs": both, "queries": q}
    for name in ("bm25", "bm25-chunks", "bm25-chunks-bodies"):
        got = [r.doc for r in rungs.RUNGS[name](t).orderBy("rank").collect()]
        assert sorted(got) == ["shop/audit.py", "shop/cart.py", "shop/stock.py"] and got[0] == "shop/cart.py", name
    t["vectors"] = spark.createDataFrame([("own", "shop/stock.py", 0, [1.0, 0.0]), ("own", "shop/cart.py", 0, [0.6, 0.8]), ("own", "shop/cart.py", 1, [0.0, 1.0])], "corpus string, path string, pos int, embedding array<float>")
    t["query_vectors"] = spark.createDataFrame([("q", "own", [0.0, 1.0])], "query string, corpus string, query_embedding array<float>")
    assert [r.doc for r in rungs.embed(t).orderBy("rank").collect()] == ["shop/cart.py", "shop/stock.py"]
    base = rungs.hybrid(t)
    assert [r.doc for r in base.orderBy("rank").collect()] == ["shop/cart.py", "shop/stock.py", "shop/audit.py"]
    reply = spark.createDataFrame([("q", "shop/stock.py\nother/x.py")], "query string, text string")
    assert [r.doc for r in rungs.reply_reranked(base, reply, 2).orderBy("rank").collect()] == ["shop/stock.py", "shop/cart.py", "shop/audit.py"]
    t["replies"] = spark.createDataFrame([("q", "m1", "shop/stock.py"), ("q", "m2", "shop/audit.py")], "query string, model string, text string")
    assert [r.doc for r in rungs.rerank_with("m2")(t).orderBy("rank").collect()][0] == "shop/audit.py"
    t["pair_scores"] = spark.createDataFrame([("q", "shop/audit.py", 2.0)], "query string, doc string, rescore double")
    assert [r.doc for r in rungs.RUNGS["cross-encoder"](t).orderBy("rank").collect()][0] == "shop/audit.py"
    assert [r.doc for r in rungs.RUNGS["rerank-deepseek-on"](t | {"replies": t["replies"].withColumn("model", F.when(F.col("model") == "m1", "deepseek-on").otherwise("gpt-oss-high"))}).orderBy("rank").collect()][0] == "shop/stock.py"
    assert len(rungs.RUNGS) == 12
    told = rungs.agent_prompts(t, base, 3).first()
    assert told.n == 3 and "refund call fails" in told.prompt and "### shop/cart.py\ndef refund()\ndef refund(): ...\n\n### shop/stock.py\n" in told.prompt and "3 times at most" in told.prompt
    pairs = {r.doc: r.text for r in rungs.pair_texts(t, base).collect()}
    assert pairs["shop/cart.py"] == "shop/cart.py\ndef refund()\ndef refund(): ..." and len(pairs) == 3
    call = lambda name, *paths: [(name, list(paths), False, False)]
    t["steps"] = spark.createDataFrame([("q", 0, "", 0.1, 1.0, call("read_file", "notes.txt")), ("q", 1, "", 0.1, 1.0, call("submit_ranking", "notes.txt", "nope"))], agent.STEP_SCHEMA)
    t["steps"] = t["steps"].union(spark.createDataFrame([("q", 2, "", 0.1, 1.0, call("submit_ranking", "shop/stock.py"))], agent.STEP_SCHEMA))
    for name in ("agent", "agent-no-tools"):
        assert [r.doc for r in rungs.RUNGS[name](t).orderBy("rank").collect()] == ["shop/stock.py", "shop/cart.py", "shop/audit.py"]


def test_git_filters_reach_the_reader_and_objects_are_dealt_out(spark, clone, tmp_path):
    root, pins = clone
    tree.register(spark)
    source = lambda kind: spark.read.format(kind).option("root", str(root)).option("pins", ",".join(f"own/name@{p}" for p in pins)).option("slices", 4).load()
    whole = source("git_tree")
    plain = sorted(map(tuple, whole.collect()))
    for holds, by in ((F.col("path").startswith("shop/"), lambda r: r[2].startswith("shop/")), (F.col("path").isin("shop/cart.py", "none"), lambda r: r[2] == "shop/cart.py"), (F.col("commit") == pins[1], lambda r: r[1] == pins[1]), (F.col("repo") == "else/where", lambda r: False)):
        some = whole.where(holds)
        assert sorted(map(tuple, some.collect())) == [r for r in plain if by(r)]
        assert not re.search(r"\bFilter ", some._jdf.queryExecution().executedPlan().toString())  # nothing is left for Spark to filter
    assert whole.where(F.col("commit") == pins[1]).rdd.getNumPartitions() == 1
    blobs = source("git_blobs")
    assert blobs.rdd.getNumPartitions() == 4
    texts = {(r.blob, r.text) for r in blobs.collect()}
    assert blobs.count() == len(texts) == len({r[3] for r in plain})  # once, in however many commits
    table = spark.createDataFrame([("own/name", p) for p in pins] * 2, "repo string, commit string")
    assert sorted(map(tuple, tree.trees(table, str(root)).collect())) == plain
    asked = tree.trees(table, str(root)).select("repo", "blob").union(spark.createDataFrame([("own/name", "f" * 40)], "repo string, blob string"))
    got = tree.contents(asked, str(root))
    assert {(r.blob, r.text) for r in got.collect()} == texts and got.count() == len(texts)


def test_large_objects_stream(tmp_path):
    """More objects than a pipe holds, both ways; a reader that stops early ends git."""
    repo = tmp_path / "own__big"
    subprocess.run(["git", "init", "-q", "-b", "main", str(repo)], check=True)
    stream = "".join(f"blob\nmark :{i + 1}\ndata 50\n{i:050d}\n" for i in range(3000)) + "commit refs/heads/main\nmark :9999\ncommitter a <a@b> 0 +0000\ndata 1\nx\n" + "".join(f"M 100644 :{i + 1} f{i}\n" for i in range(3000))
    subprocess.run(["git", "-C", str(repo), "fast-import", "--quiet"], input=stream.encode(), check=True)
    commit = subprocess.run(["git", "-C", str(repo), "rev-parse", "main"], check=True, capture_output=True, text=True).stdout.strip()
    names = [b for _, b in tree.listing(str(tmp_path), "own/big", commit)]
    assert [int(c) for _, c in tree.Streamed(str(repo), names)] == sorted(range(3000), key=lambda i: f"f{i}")
    assert next(iter(tree.Streamed(str(repo), names)))[0] == names[0]


def test_single_reads_and_kept_listings(spark, clone, tmp_path):
    root, pins = str(clone[0]), clone[1]
    assert tree.has_clone(root, "own/name") and not tree.has_clone(root, "own/other")
    assert tree.has_commit(root, "own/name", pins[0]) and not tree.has_commit(root, "own/name", "f" * 40) and not tree.has_commit(root, "own/other", pins[0])
    assert tree.read_file(root, "own/name", pins[0], "shop/cart.py") == "class Cart: ...\n"
    blobs = dict(tree.listing(root, "own/name", pins[1]))
    assert tree.read_blob(root, "own/name", blobs["shop/cart.py"]) == "def refund(): ...\n"
    for wrong in (lambda: tree.read_file(root, "own/name", pins[2], "shop/stock.py"), lambda: tree.read_blob(root, "own/name", "f" * 40), lambda: tree.listing(root, "own/name", "f" * 40, str(tmp_path))):
        with pytest.raises(tree.CommitUnavailable):
            wrong()
    made = tree.listing(root, "own/name", pins[1], str(tmp_path))
    assert dict(made) == blobs and [f.name for f in (tmp_path / "own__name").iterdir()] == [f"{pins[1]}.json"]
    (tmp_path / "own__name" / f"{pins[1]}.json").write_text('[["kept", "there"]]')
    assert tree.listing(root, "own/name", pins[1], str(tmp_path)) == [("kept", "there")]
    tree.register(spark)
    kept = spark.read.format("git_tree").option("root", root).option("pins", f"own/name@{pins[1]}").option("cache", str(tmp_path)).load()
    assert [r.path for r in kept.collect()] == ["kept"]
    (tmp_path / "own__name" / f"{pins[1]}.json").write_text("[broken")
    assert dict(tree.listing(root, "own/name", pins[1], str(tmp_path))) == blobs


def test_split_files(spark, tmp_path):
    sides = spark.createDataFrame([("b", "dev"), ("a", "dev"), ("c", "test"), ("a", "ci")], "instance_id string, side string")
    split = split_file.of_table(sides, dataset="d", revision="r", seed=7)
    path = str(tmp_path / "split.json")
    split_file.write(split, path)
    assert split_file.read(path) == split and (split.dev, split.test, split.ci_slice) == (("a", "b"), ("c",), ("a",))
    text = (tmp_path / "split.json").read_text()
    assert text.startswith('{\n  "dataset": "d",\n  "revision": "r",\n  "seed": 7,\n  "dev_count": 2') and '\n    "b"\n' in text
    rows = spark.createDataFrame([("b", 1), ("x", 2), ("a", 3)], "instance_id string, v int")
    assert [r.v for r in splits.select_side(rows, split.rows(spark), "dev").collect()] == [3, 1]
    (tmp_path / "split.json").write_text(text.replace('"dev_count": 2', '"dev_count": 3'))
    for bad in (path, str(tmp_path / "none.json")):
        with pytest.raises(split_file.SplitFileError):
            split_file.read(bad)


def test_seeded_sample_is_the_generators(spark):
    ids = [f"i{n:03}" for n in range(300)]
    df = spark.createDataFrame([(i,) for i in random.Random(9).sample(ids, 300)], "instance_id string").repartition(5)
    for n, seed in ((40, 0), (40, 3), (999, 0)):
        assert [r.instance_id for r in splits.seeded_sample(df, n, seed=seed).collect()] == random.Random(seed).sample(ids, min(n, 300))
    assert splits.seeded_sample(df.limit(0), 3).count() == 0


def test_agent_keys(spark):
    kind = "name string, messages array<struct<type:string,content:string,tool_calls:array<string>,tool_call_id:string>>, tools array<string>"
    ask = [("human", "find it", None, None)]
    rows = [("base", ask, ["t1"]), ("again", [("human", "find it", [], "")], ["t1"]), ("tools", ask, ["t2"]), ("longer", [*ask, ("ai", None, ["grep"], None)], ["t1"]), ("none", ask, None), ("empty", ask, [])]
    got = {r.name: r.k for r in spark.createDataFrame(rows, kind).select("name", cache.agent_key("messages", "tools").alias("k")).collect()}
    setting = {"model": F.lit("m"), "provider": F.lit("p"), "reasoning": F.lit("low"), "max_tokens": F.lit(100)}
    settings = [setting, setting | {"max_tokens": F.lit(101)}, setting | {"model": F.lit("n")}, setting | {"reasoning": F.lit("high")}]
    one = spark.createDataFrame(rows[:1], kind)
    assert len({one.select(cache.step_key("messages", "tools", **x)).first()[0] for x in [*settings, setting]}) == 4
    assert got["base"] == got["again"] and got["none"] == got["empty"] and len(set(got.values())) == 4


def test_index(spark, tmp_path):
    model = index.Model("a/b", "0123456789abcdef", 2)
    root = str(tmp_path / "index")
    assert model.slug == "a__b@0123456789ab" and index.open_index(spark, root, model) is None
    v = spark.createDataFrame([("b1", 0, [1.0, 0.0])], "blob string, pos int, embedding array<float>")
    index.append(v, root, model)
    got = index.open_index(spark, root, model)
    assert got.count() == 1
    with pytest.raises(index.IndexIncompatible):
        index.open_index(spark, root, index.Model("a/b", "0123456789abcdef", 3))
    with pytest.raises(index.IndexMissing, match="b2"):
        index.require(spark.createDataFrame([("b1",), ("b2",)], "blob string"), got)
    with pytest.raises(Exception, match="vectors of 2"):
        index.append(v.withColumns({"blob": F.lit("b2"), "embedding": F.array(F.lit(1.0).cast("float"))}), root, model)
    assert index.open_index(spark, root, model).count() == 1 and index.size(spark, root, model) == (1, 8)  # what the failed write left is not seen
    more = v.unionByName(v.withColumns({"blob": F.lit("b2")})).unionByName(v.withColumns({"blob": F.lit("b2"), "pos": F.lit(1)}))
    assert [index.append(more, root, model) for _ in range(2)] == [1, 0] and index.size(spark, root, model) == (2, 24)
    assert {(r.blob, r.indexed) for r in index.has(spark.createDataFrame([("b2",), ("b3",)], "blob string"), root, model).collect()} == {("b2", True), ("b3", False)}


def test_two_index_writers(spark, tmp_path, monkeypatch):
    model, root = index.Model("m", "r" * 12, 1), str(tmp_path / "i")
    v = spark.createDataFrame([("b1", 0, [1.0]), ("b2", 0, [2.0])], "blob string, pos int, embedding array<float>")
    commit, late = index.Log.commit, [True]

    def second(log, *args, **meta):
        if late.pop() if late else False:  # the other writer is done between this one's look and its commit
            assert index.append(v.where("blob = 'b1'"), root, model) == 1
        commit(log, *args, **meta)

    monkeypatch.setattr(index.Log, "commit", second)
    assert index.append(v, root, model) == 1
    assert sorted(r.blob for r in index.open_index(spark, root, model).collect()) == ["b1", "b2"]


def test_index_follows_a_stream(spark, tmp_path):
    model, root, source = index.Model("m", "r" * 12, 4), str(tmp_path / "i"), str(tmp_path / "in")
    stream = lambda: spark.readStream.schema("blob string, text string").parquet(source)
    for n, rows in enumerate(([("b1", "x = 1"), ("b1", "x = 1")], [("b1", "x = 1"), ("b2", "def f(): pass")])):
        spark.createDataFrame(rows, "blob string, text string").write.mode("append").parquet(source)
        incremental.follow(stream(), root, model, hashed_encoder(4), str(tmp_path / "c")).awaitTermination(120)
        assert sorted(r.blob for r in index.open_index(spark, root, model).collect()) == ["b1", "b2"][: n + 1]


def test_cache(spark):
    req = spark.createDataFrame([("p1", "m"), ("p2", "m"), ("p1", "other"), (None, "m")], "prompt string, model string").withColumn("key", cache.cache_key("model", "prompt"))
    assert req.select("key").distinct().count() == 4
    saved = spark.createDataFrame([("p1", "m", "hello", 0.5), ("p2", "m", None, 0.1)], "prompt string, model string, text string, cost double").select(cache.cache_key("model", "prompt").alias("key"), "text", "cost")
    got = {(r.prompt, r.model): (r.text, r.cached) for r in cache.lookup(req, saved).collect()}
    assert got == {("p1", "m"): ("hello", True), ("p2", "m"): (None, False), ("p1", "other"): (None, False), (None, "m"): (None, False)}


def test_retries():
    waits = []
    answers = [remote.Reply(503, {}), remote.Reply(200, {"error": {"code": 429}}, 7.0), remote.Reply(200, {"ok": 1})]
    assert remote.send(lambda: answers.pop(0), waits.append) == {"ok": 1} and waits == [2.0, 7.0]
    with pytest.raises(remote.RemoteError):
        remote.send(lambda: remote.Reply(400, {}), waits.append)

    def broken():
        raise ConnectionError("gone")

    waits.clear()
    with pytest.raises(remote.RemoteError, match="gone"):
        remote.send(broken, waits.append)
    assert waits == [2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 120.0]


def test_replies_on_executors(spark):
    made = remote.replies(spark.createDataFrame([("k", "p")], "key string, prompt string"), lambda p: {"text": p.upper(), "cost": 0.1, "finish_reason": "stop", "provider": "x", "output_tokens": 1, "reasoning_tokens": 0})
    assert made.first().text == "P"


def test_calls_have_a_deadline():
    began, tries = time.monotonic(), []

    def slow():
        tries.append(None)
        if len(tries) < 3:
            time.sleep(30)
        return remote.Reply(200, {"ok": len(tries)})

    counted = []
    assert remote.send(slow, lambda s: None, 0.2, lambda: counted.append(None)) == {"ok": 3} and len(counted) == 2 and time.monotonic() - began < 10
    with pytest.raises(KeyError):
        remote.send(lambda: {}["x"], lambda s: None, 1.0)


def test_replies_are_stored_as_they_come(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(prompt):
        n = len(list(calls.glob(f"{prompt}-*")))
        (calls / f"{prompt}-{n}").touch()
        if prompt == "bad":
            return remote.Reply(400, {})
        if prompt == "busy" and n < 2:
            return remote.Reply(503, {})
        return remote.Reply(200, {"text": None if prompt == "none" and n == 0 else prompt.upper(), "cost": 0.5, "finish_reason": "length" if prompt == "long" else "stop"})

    ask = lambda *p: spark.createDataFrame([(f"k-{x}", x) for x in p], "key string, prompt string")
    run = lambda df: remote.answered(df, call, str(tmp_path / "store"), waves=3, sleep=lambda s: None)
    counts = lambda df: remote.counters(df).first().asDict()
    first = run(ask("a", "busy", "long", "none", "a"))
    assert {r.prompt: (r.text, r.cached, r.retries) for r in first.collect()} == {"a": ("A", False, 0), "busy": ("BUSY", False, 2), "long": ("LONG", False, 0), "none": (None, False, 0)}
    assert counts(first) == {"calls": 4, "cache_hits": 0, "retries": 2, "truncated": 1, "empty": 1, "spent": 2.0} and first.count() == 5
    made = len(list(calls.iterdir()))
    again = run(ask("a", "busy", "long"))
    assert counts(again)["calls"] == 0 and counts(again)["cache_hits"] == 3 and len(list(calls.iterdir())) == made
    with pytest.raises(Exception, match="status 400"):
        run(ask("bad"))
    last = run(ask("a", "none", "new"))
    assert {r.prompt: (r.text, r.cached) for r in last.collect()} == {"a": ("A", True), "none": ("NONE", False), "new": ("NEW", False)}
    assert run(ask("x").limit(0)).count() == 0


def test_keys_and_budgets(spark, monkeypatch):
    monkeypatch.setenv("RE_KEY", " k ")
    assert remote.api_key("RE_KEY") == "k"
    monkeypatch.setenv("RE_KEY", " ")
    with pytest.raises(remote.MissingKey, match="RE_KEY"):
        remote.api_key("RE_KEY")
    remote.within_budget(0.0, 0, 1.0)
    remote.within_budget(0.5, 1, 1.0)
    for spent, calls in ((1.0, 5), (0.9, 1)):
        with pytest.raises(remote.BudgetSpent):
            remote.within_budget(spent, calls, 1.0)
    q = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.text for r in index.query_texts(q, index.Model("m", "r", 2, "ask: ")).collect()] == ["ask: a", "ask: "]


def test_env(tmp_path, monkeypatch):
    monkeypatch.setenv("RE_SET", "kept")
    f = tmp_path / ".env"
    f.write_text("# c\n\nRE_SET=new\nRE_NEW='x y'\nbroken\n")
    assert remote.load_env(str(f)) == {"RE_SET": "new", "RE_NEW": "x y"}
    import os

    assert os.environ["RE_SET"] == "kept" and os.environ.pop("RE_NEW") == "x y"


def test_dataset(spark):
    patch = lambda *files: "".join(f"diff --git a/{f} b/{f}\n" for f in files)
    rows = [("i1", "o/r", "a" * 40, "issue", patch("p/a.py", "tests/t.py"), "leak"), ("i2", "o/r", "a" * 40, "issue", patch("README.md"), "leak"), ("i3", "o/r", "a" * 40, "issue", patch("a", "b", "c", "d"), "leak")]
    raw = spark.createDataFrame(rows, "instance_id string, repo string, base_commit string, problem_statement string, patch string, hints_text string")
    kept = dataset.instances(raw)
    assert "hints_text" not in dataset.classified(raw).columns and [tuple(r) for r in kept.collect()] == [("i1", "o/r", "a" * 40, "issue", ["p/a.py"])]
    r = dataset.load_report(dataset.classified(raw)).first()
    assert (r.total, r.kept, r.no_source_files, r.too_many_source_files) == (3, 1, 1, 1)
    assert dataset.load_report(dataset.classified(raw.limit(0))).first().filter_rate == 0
    with pytest.raises(Exception, match="not an instance"):
        dataset.instances(raw.withColumn("base_commit", F.lit("A" * 40))).collect()


def test_reports(spark):
    total = {"n": 4, "top_1": 0.5, "ci_low": 0.15, "ci_high": 0.85, "recall_3": 0.5, "recall_5": 0.75, "cost_total": 1.5, "cost_each": 0.375}
    entry = lambda date, rung: report.entry({"date": date, "rung": rung, "split": "dev", "sha": "abc", "command": "x"}, total, [{"group": "o/r", "n": 4, "top_1": 0.5}], {"answered": 4}, 83)
    log = report.prepended(report.prepended(report.prepended("", entry("2026-01-01", "bm25")), entry("2026-01-02", "bm25")), entry("2026-01-03", "embed"))
    rows = {r.rung: r for r in report.newest(report.parse_log(spark, log)).collect()}
    assert rows["bm25"].run_date == "2026-01-02" and rows["embed"].top_1 == 50.0 and rows["embed"].n == 4 and log.startswith(report.HEADER) and "1m 23s" in log
    assert "Uncommitted" in report.entry({"date": "d", "rung": "r", "split": "s", "sha": "a-dirty", "command": "x"}, total, [], {}, 1)
    c = {"n": 4, "delta": 0.25, "both_hit": 1, "both_miss": 1, "a_only": 0, "b_only": 1, "p_value": 1.0, "verdict": "nothing established"}
    assert "Nothing is established" in report.comparison(c, "x", "y")
    assert report.notes({"off_list": 2}, False) == "Degraded: 2 off-list paths." and report.notes({"off_list": 2}, True).startswith("Guardrail") and report.notes({}, False) == ""
