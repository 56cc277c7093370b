"""Queries over rankings, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankeval.functions import order, stats
from rankeval.functions.text import normalize_path, tokenize
from rankeval.operators import agent, budget, dense, evaluate, lexical, ranking, splits
from rankeval.plans.base import SQL_LINES, Tables, order_paths, query, sql_bm25, sql_log_mcnemar, sql_mcnemar, sql_norm, sql_quantile, sql_tokens, sql_windows, sql_wilson
from rankeval.sources.postings import ready

# ---------------------------------------------------------------- lexical and dense retrieval


def _items(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query"), F.lit(0).alias("corpus"), tokenize("text").alias("tokens"))


_DOCS, _ITEMS = f"SELECT doc_id AS doc, {sql_tokens('text')} AS toks FROM documents", f"SELECT item_id AS query, {sql_tokens('text')} AS toks FROM benchmark"
_TOP = """ranked AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM
(SELECT q.query, d.doc, coalesce(s.score, 0.0) AS score FROM q, d LEFT JOIN s ON s.query = q.query AND s.doc = d.doc))"""


def _topk(t: Tables, k: int) -> DataFrame:
    """From the stored postings of the documents, which are made at the first use."""
    d = t.documents
    docs = d.select(F.lit(0).alias("corpus"), F.col("doc_id").alias("doc"), "text")
    index = ready(t.spark, t.store("documents", d), docs, lambda new: new.select("corpus", "doc", F.lit(0).alias("pos"), tokenize("text").alias("tokens")))
    return index.search(_items(t), k)


@query(f"WITH {sql_bm25(_DOCS, _ITEMS)}, {_TOP} SELECT query AS item_id, doc AS doc_id, score, rank::BIGINT AS rank FROM ranked WHERE rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return _topk(t, 10).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {sql_bm25(_DOCS, _ITEMS)}, {_TOP}, tr AS (SELECT b.item_id, d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)),
e AS (SELECT tr.item_id, count(*) AS n, count(r.doc) AS found, coalesce(max(CASE WHEN r.rank = 1 THEN 1 ELSE 0 END), 0) AS hit FROM tr LEFT JOIN ranked r ON r.query = tr.item_id AND r.doc = tr.doc_id AND r.rank <= 10 GROUP BY tr.item_id)
SELECT count(*)::BIGINT AS n, sum(hit)::BIGINT AS hits, round(avg(found / n), 6) AS recall_10 FROM e""")
def retrieval_eval(t: Tables) -> DataFrame:
    """How well BM25 finds the documents that hold an item's text."""
    from rankeval.plans.text_queries import contains_join

    truth = contains_join(t)
    top = bm25_topk(t).select("item_id", "doc_id", "rank")
    each = truth.join(top, ["item_id", "doc_id"], "left").groupBy("item_id").agg((F.count("rank") / F.count(F.lit(1))).alias("recall"), F.coalesce(F.max(F.col("rank") == 1), F.lit(False)).alias("hit"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg("recall"), 6).alias("recall_10"))


_CHUNKS = f"SELECT (doc_id, i) AS doc, {sql_tokens('x')} AS toks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"


@query(f"""WITH {sql_bm25(_CHUNKS, _ITEMS)}, p AS (SELECT query, doc[1] AS doc_id, min((-score, doc[2])) AS b FROM s WHERE score > 0 GROUP BY ALL),
e AS (SELECT q.query, d.doc_id, coalesce(-p.b[1], 0.0) AS score, coalesce(p.b[2], 0) AS pos FROM q CROSS JOIN (SELECT DISTINCT doc[1] AS doc_id FROM d) d LEFT JOIN p ON p.query = q.query AND p.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM e) SELECT query AS item_id, doc_id, score, pos::INT AS pos, rank::BIGINT AS rank FROM r WHERE rank <= 10""")
def bm25_chunks(t: Tables) -> DataFrame:
    """Lines as chunks: a document scores as its best line, and names it."""
    d = t.documents
    docs = d.select(F.lit(0).alias("corpus"), F.col("doc_id").alias("doc"), "text")
    lines = lambda new: new.select("corpus", "doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "x")).select("corpus", "doc", "pos", tokenize("x").alias("tokens"))
    top = ready(t.spark, t.store("lines", d), docs, lines).search(_items(t), 10)
    return top.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "pos", F.col("rank").cast("long").alias("rank"))


_DOT = "round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"


@query(f"WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, {_DOT} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) SELECT query, id, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def dense_topk(t: Tables) -> DataFrame:
    """The query set is every vector whose id is divisible by 50."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))
    return dense.top_k(v, q, 10).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH s AS (SELECT q.vec_id AS query, v.label, {_DOT} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) SELECT query, label, max(score) AS score FROM s GROUP BY ALL")
def dense_max(t: Tables) -> DataFrame:
    """Vectors as chunks of the file that is their label: the best one counts."""
    v = t.embeddings.select(F.col("label").alias("path"), F.col("vec_id").alias("pos"), "embedding")
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))
    return dense.best_of(v, q).select("query", F.col("path").alias("label"), "score")


@query(f"""WITH {sql_bm25(_DOCS, _ITEMS)}, {_TOP}, other AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score, doc) AS rank FROM ranked WHERE rank <= 20),
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM other) GROUP BY ALL)
SELECT query AS item_id, doc AS doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::BIGINT AS rank FROM f""")
def hybrid_rrf(t: Tables) -> DataFrame:
    """Two lists of the same candidates, the second in the reverse order, fused by reciprocal ranks."""
    first = _topk(t, 20).select("query", "doc", "score", "rank")
    second = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "doc")))
    lists = first.select("query", "doc", "rank", F.lit(0).alias("list")).unionByName(second.select("query", "doc", "rank", F.lit(1).alias("list")))
    return ranking.rrf(lists).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- lists

_LISTS = """a AS (SELECT l_suppkey AS query, l_partkey AS doc, max(l_extendedprice) AS x, sum(l_quantity) AS y FROM lineitem GROUP BY ALL),
l AS (SELECT query, doc, 0 AS list, row_number() OVER (PARTITION BY query ORDER BY x DESC, doc) AS rank FROM a UNION ALL SELECT query, doc, 1, row_number() OVER (PARTITION BY query ORDER BY y DESC, doc) FROM a)"""


def _lists(t: Tables) -> DataFrame:
    """Two rankings of each supplier's parts: by the best price and by quantity."""
    a = t.lineitem.groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("doc")).agg(F.max("l_extendedprice").alias("x"), F.sum("l_quantity").alias("y"))
    one = lambda i, c: ranking.ranked(a, "query", score=c).select("query", "doc", F.lit(i).alias("list"), "rank")
    return one(0, "x").unionByName(one(1, "y"))


@query(f"WITH {_LISTS}, f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY ALL) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::BIGINT AS rank FROM f")
def rrf_fusion(t: Tables) -> DataFrame:
    return ranking.rrf(_lists(t)).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_LISTS}, f AS (SELECT query, doc, min((rank, list)) AS place FROM l GROUP BY ALL) SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY place)::BIGINT AS rank FROM f")
def interleave_merge(t: Tables) -> DataFrame:
    return ranking.interleaved(_lists(t)).select("query", "doc", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_LISTS} SELECT query, doc, rank::BIGINT AS old_rank, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE rank END, CASE WHEN rank <= 20 THEN (doc * 7919) % 1009 END DESC NULLS LAST, doc)::BIGINT AS rank FROM l WHERE list = 0")
def rerank_head_tail(t: Tables) -> DataFrame:
    base = _lists(t).where("list = 0").select("query", "doc", "rank")
    scores = base.select("query", "doc", ((F.col("doc") * 7919) % 1009).alias("rescore"))
    return ranking.rerank_head(base, scores).select("query", "doc", F.col("old_rank").cast("long").alias("old_rank"), F.col("rank").cast("long").alias("rank"))


def _order_lists(t: Tables) -> DataFrame:
    """(o, paths by price, the same with odd slashes where returned)."""
    odd = F.when(F.col("flag") == "R", F.concat(F.lit(".//"), "path"))
    rows = order_paths(t).groupBy("o").agg(F.sort_array(F.collect_list(F.struct((-F.col("price")).alias("p"), "path", odd.alias("odd")))).alias("l"))
    return rows.select("o", F.transform("l", lambda x: x["path"]).alias("ranking"), F.array_compact(F.transform("l", lambda x: x["odd"])).alias("truth"))


_ORDER_LISTS = f"{SQL_LINES}, ol AS (SELECT o, list(path ORDER BY -price, path, CASE WHEN flag = 'R' THEN './/' || path END NULLS FIRST) AS ranking, coalesce(list('.//' || path ORDER BY -price, path) FILTER (flag = 'R'), []) AS truth FROM lines GROUP BY o)"


def _sql_recall(k: int) -> str:
    tr = f"list_distinct(list_transform(truth, lambda x: {sql_norm('x')}))"
    return f"CASE WHEN len(truth) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(ranking[1:{k}]), {tr}))::DOUBLE / len({tr}) END"


@query(f"WITH {_ORDER_LISTS} SELECT o, round({_sql_recall(1)}, 6) AS r1, round({_sql_recall(3)}, 6) AS r3, round({_sql_recall(5)}, 6) AS r5 FROM ol")
def recall_at_k(t: Tables) -> DataFrame:
    return _order_lists(t).select("o", *(F.round(ranking.recall_at(F.col("ranking"), F.col("truth"), k), 6).alias(f"r{k}") for k in (1, 3, 5)))


@query(f"WITH {_ORDER_LISTS} SELECT o, {', '.join(f'''list_has_any(ranking[1:{k}], list_transform(truth, lambda x: {sql_norm('x')})) AS h{k}''' for k in (1, 3, 5))} FROM ol")
def hit_at_k(t: Tables) -> DataFrame:
    plain = _order_lists(t).withColumn("truth", F.transform("truth", normalize_path))
    return plain.select("o", *(ranking.hit_at(F.col("ranking"), F.col("truth"), k).alias(f"h{k}") for k in (1, 3, 5)))


@query(f"WITH {_ORDER_LISTS} SELECT o, coalesce(list_contains(list_transform(truth, lambda x: {sql_norm('x')}), ranking[1]), false) AS hit FROM ol")
def top1_hit(t: Tables) -> DataFrame:
    return _order_lists(t).select("o", ranking.top1(F.col("ranking"), F.col("truth")).alias("hit"))


@query(f"WITH {_ORDER_LISTS}, k AS (SELECT o_orderpriority AS variant, {', '.join(f'''avg(list_has_any(ranking[1:{k}], list_transform(truth, lambda x: {sql_norm('x')}))::INT) AS hit_{k}''' for k in (1, 3, 5))}, avg(len(ranking)) AS long FROM ol JOIN orders ON o = o_orderkey WHERE len(truth) > 0 GROUP BY ALL) SELECT variant, round(hit_1, 6) AS hit_1, round(hit_3, 6) AS hit_3, round(hit_5, 6) AS hit_5 FROM k")
def ceiling_pivot(t: Tables) -> DataFrame:
    """Best possible hit rates of variants at several depths, side by side."""
    rows = _order_lists(t).where(F.size("truth") > 0).join(t.orders.select(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("variant")), "o")
    rows = rows.withColumn("truth", F.transform("truth", normalize_path)).withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5)))))
    hit = F.coalesce(F.arrays_overlap(F.slice("ranking", F.lit(1), F.col("k")), "truth"), F.lit(False)).cast("int")
    p = rows.select("variant", "k", hit.alias("hit")).groupBy("variant").pivot("k", [1, 3, 5]).agg(F.round(F.avg("hit"), 6))
    return p.select("variant", *(F.col(str(k)).alias(f"hit_{k}") for k in (1, 3, 5)))


@query(f"WITH {_ORDER_LISTS}, a AS (SELECT o, list_concat(truth, ranking) AS l FROM ol) SELECT o, array_to_string(list_filter(list_transform(l, lambda x: {sql_norm('x')}), lambda x, i: list_position(list_transform(l, lambda y: {sql_norm('y')}), x) = i), ',') AS answer FROM a")
def assemble_answer(t: Tables) -> DataFrame:
    return _order_lists(t).select("o", F.array_join(ranking.assembled(F.col("truth"), F.col("ranking")), ",").alias("answer"))


_REPLY = f"{SQL_LINES}, h AS (SELECT o, list(DISTINCT path ORDER BY path) AS head FROM lines GROUP BY o), r AS (SELECT o, head, list_concat(list_transform(list_reverse(head[2:]), lambda p, i: (['- ', '1. ', '', '  * '])[i % 4 + 1] || CASE WHEN i % 3 = 0 THEN chr(96) || p || chr(96) ELSE p END), ['and other/mod.py', 'Some prose.', '']) AS reply FROM h)"


@query(rf"""WITH {_REPLY}, c AS (SELECT o, head, list_transform(reply, lambda x: trim(regexp_replace(regexp_replace(trim(x), '^`+|`+$', '', 'g'), '^[-*0123456789. ]+', ''))) AS l FROM r),
f AS (SELECT o, head, list_filter(l, lambda x: list_contains(head, x)) AS found, len(list_filter(l, lambda x: x <> '' AND NOT list_contains(head, x) AND (contains(x, '/') OR ends_with(x, '.py')))) AS off FROM c)
SELECT o, array_to_string(CASE WHEN len(found) = 0 THEN head ELSE list_concat(list_filter(found, lambda x, i: list_position(found, x) = i), list_filter(head, lambda x: NOT list_contains(found, x))) END, ',') AS ranking, off::BIGINT AS off_list, len(found) = 0 AS unparseable FROM f""")
def parse_reply(t: Tables) -> DataFrame:
    h = order_paths(t).groupBy("o").agg(F.sort_array(F.collect_set("path")).alias("head"))
    mark = lambda p, i: F.concat(F.element_at(F.array(*map(F.lit, ("- ", "1. ", "", "  * "))), ((i + 1) % 4 + 1).cast("int")), F.when((i + 1) % 3 == 0, F.concat(F.lit("`"), p, F.lit("`"))).otherwise(p))
    said = F.concat(F.transform(F.reverse(F.slice("head", 2, 1000000)), mark), F.array(F.lit("and other/mod.py"), F.lit("Some prose."), F.lit("")))
    p = h.select("o", ranking.parsed_reply(F.array_join(said, "\n"), F.col("head")).alias("p"))
    return p.select("o", F.array_join("p.ranking", ",").alias("ranking"), F.col("p.off_list").cast("long").alias("off_list"), "p.unparseable")


def _submitted(t: Tables) -> DataFrame:
    return order_paths(t).select(F.col("o").alias("query"), F.col("flag").alias("corpus"), F.col("n").alias("seq"), F.concat(F.lit("./"), "path").alias("path"))


@query(f"""WITH {SQL_LINES}, tree AS (SELECT DISTINCT flag AS corpus, path FROM lines WHERE price > 30000) SELECT s.o AS query, s.flag AS corpus, min(s.n) AS seq, s.path, bool_or(t.path IS NOT NULL) AS "exists" FROM lines s LEFT JOIN tree t ON t.corpus = s.flag AND t.path = s.path GROUP BY s.o, s.flag, s.path""")
def path_guardrail(t: Tables) -> DataFrame:
    tree = order_paths(t).where("price > 30000").select(F.col("flag").alias("corpus"), "path")
    return ranking.guardrail(_submitted(t), tree)


@query(f"WITH {SQL_LINES}, c AS (SELECT o, path, row_number() OVER (PARTITION BY o ORDER BY price DESC, path) AS rank FROM (SELECT o, path, max(price) AS price FROM lines GROUP BY ALL)) SELECT DISTINCT l.o AS query, l.path FROM lines l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o = l.o AND c.path = l.path AND c.rank <= 2)")
def off_list_anti(t: Tables) -> DataFrame:
    """Paths of an order beyond its two dearest."""
    rows = order_paths(t).groupBy(F.col("o").alias("query"), "path").agg(F.max("price").alias("price"))
    candidates = ranking.ranked(rows, "query", score="price", doc="path")
    return ranking.off_list(rows.select("query", "path"), candidates, 2)


@query("SELECT l_suppkey AS query, l_partkey AS doc, max(0.05 - l_discount) AS score FROM lineitem GROUP BY ALL")
def chunk_max(t: Tables) -> DataFrame:
    """The best score of a document's chunks, negative ones as they are."""
    s = t.lineitem.select(F.col("l_suppkey").alias("query"), F.lit(0).alias("corpus"), F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("pos"), (0.05 - F.col("l_discount")).alias("score"))
    return lexical.best_chunk(s).select("query", F.col("path").alias("doc"), "score")


@query("WITH b AS (SELECT l_suppkey, l_partkey, max(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT l.l_suppkey AS query, l.l_partkey AS doc, b.m AS score, min(l.l_orderkey) AS pos FROM lineitem l JOIN b ON b.l_suppkey = l.l_suppkey AND b.l_partkey = l.l_partkey AND b.m = l.l_discount GROUP BY ALL")
def evidence_chunk(t: Tables) -> DataFrame:
    """The chunk that gives a document its score, the earliest of equals."""
    s = t.lineitem.select(F.col("l_suppkey").alias("query"), F.lit(0).alias("corpus"), F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("pos"), F.col("l_discount").alias("score"))
    return lexical.best_chunk(s).select("query", F.col("path").alias("doc"), "score", "pos")


# ---------------------------------------------------------------- evaluation


def _scores(t: Tables) -> DataFrame:
    """A score row for each order; its customer is the group, so some groups are small."""
    return t.orders.select(
        F.col("o_orderkey").alias("instance_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("grp"), (F.col("o_totalprice") > 150000).alias("hit"), ((F.col("o_orderkey") % 4) / 4.0).alias("recall_3"),
        ((F.col("o_orderkey") % 3) / 2.0).alias("recall_5"), (F.col("o_totalprice") / 1000).alias("latency"), (F.sqrt("o_totalprice") / 1000).alias("cost"),
    )


_SCORES = "sc AS (SELECT o_orderkey AS instance_id, 'c' || o_custkey AS grp, o_totalprice > 150000 AS hit, (o_orderkey % 4) / 4.0::DOUBLE AS recall_3, (o_orderkey % 3) / 2.0::DOUBLE AS recall_5, o_totalprice / 1000 AS latency, sqrt(o_totalprice) / 1000 AS cost FROM orders)"
_LOW, _HIGH = sql_wilson("count(*) FILTER (hit)", "count(*)")
_MEASURES = f"count(*)::BIGINT AS n, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS top_1, round({_LOW}, 6) AS ci_low, round({_HIGH}, 6) AS ci_high, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, round(sum(latency), 6) AS latency_total, round(list_sort(list(latency))[count(*) // 2 + 1], 6) AS latency_median, round(sum(cost), 6) AS cost_total, round(sum(cost) / count(*), 6) AS cost_each"
_BUCKETS = f"{_SCORES}, bk AS (SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY grp) < 3 THEN 'other' ELSE grp END AS grp) FROM sc)"


@query(f"WITH {_SCORES} SELECT {_MEASURES} FROM sc")
def score_overall(t: Tables) -> DataFrame:
    return evaluate.overall(_scores(t))


@query(f"WITH {_BUCKETS} SELECT grp, {_MEASURES} FROM bk GROUP BY grp")
def score_by_group_other(t: Tables) -> DataFrame:
    return evaluate.by_group(_scores(t), "grp")


@query(f"WITH {_BUCKETS} SELECT grp, {_MEASURES} FROM bk GROUP BY GROUPING SETS ((), (grp))")
def score_grouping_sets(t: Tables) -> DataFrame:
    return evaluate.report(_scores(t), "grp")


@query("SELECT o_orderkey AS instance_id, o_custkey % 2 = 0 AS hit, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def score_join(t: Tables) -> DataFrame:
    """Predictions with their truth; one without would be refused."""
    p = t.orders.select(F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("k"))
    truth = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("instance_id"), F.col("c_mktsegment").alias("segment"))
    return evaluate.joined(p, truth).select("instance_id", (F.col("k") % 2 == 0).alias("hit"), "segment")


@query(f"""WITH {_ORDER_LISTS} SELECT o AS instance_id, o_orderpriority AS grp, coalesce(list_contains(list_transform(truth, lambda x: {sql_norm('x')}), ranking[1]), false) AS hit,
round({_sql_recall(3)}, 6) AS recall_3, round({_sql_recall(5)}, 6) AS recall_5, o_totalprice / 1000 AS latency, 0.0::DOUBLE AS cost, o_orderstatus AS stop FROM ol JOIN orders ON o = o_orderkey""")
def score_instances(t: Tables) -> DataFrame:
    """The order of an order's parts scored against those returned; its priority is the group."""
    lists, o = _order_lists(t), t.orders
    about = o.select(F.col("o_orderkey").alias("o"), (F.col("o_totalprice") / 1000).alias("latency"), F.lit(0.0).alias("cost"), F.col("o_orderstatus").alias("stop"))
    predictions = lists.join(about, "o").select(F.col("o").alias("instance_id"), F.col("ranking").alias("ranked_files"), "latency", "cost", "stop")
    instances = lists.join(o.select(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("grp")), "o").select(F.col("o").alias("instance_id"), "grp", "truth")
    return evaluate.scores(predictions, instances).withColumns({c: F.round(c, 6) for c in ("recall_3", "recall_5")})


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def stop_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) FILTER (c_acctbal > 4000)::BIGINT AS hits, count(*)::BIGINT AS n, round({}, 6) AS low, round({}, 6) AS high FROM customer GROUP BY c_mktsegment".format(*sql_wilson("count(*) FILTER (c_acctbal > 4000)", "count(*)")))
def wilson_ci(t: Tables) -> DataFrame:
    g = t.customer.groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 4000).alias("hits"), F.count(F.lit(1)).alias("n"))
    ci = stats.wilson("hits", "n")
    return g.select("c_mktsegment", "hits", "n", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


@query(f"SELECT l_suppkey, a, b, round({sql_mcnemar('a', 'b')}, 8) AS p_value, round({sql_log_mcnemar('a', 'b')}, 6) AS log_p FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_quantity > 35) AS b FROM lineitem GROUP BY l_suppkey)")
def mcnemar_exact(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_quantity") > 35).alias("b"))
    return g.select("l_suppkey", "a", "b", F.round(stats.mcnemar("a", "b"), 8).alias("p_value"), F.round(stats.log_mcnemar("a", "b"), 6).alias("log_p"))


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders.select(F.col("o_orderkey").cast("string").alias("instance_id"), "o_totalprice", "o_custkey")
    return o.select("instance_id", (F.col("o_totalprice") > 250000).alias("hit")), o.select("instance_id", (F.col("o_custkey") % 2 == 0).alias("hit"))


_PAIRS = "pr AS (SELECT o_totalprice > 250000 AS a, o_custkey % 2 = 0 AS b FROM orders), ct AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (a AND b)::BIGINT AS both_hit, count(*) FILTER (NOT a AND NOT b)::BIGINT AS both_miss, count(*) FILTER (a AND NOT b)::BIGINT AS a_only, count(*) FILTER (NOT a AND b)::BIGINT AS b_only FROM pr)"


@query("SELECT o_orderkey::VARCHAR AS instance_id, o_totalprice > 250000 AS a_hit, o_custkey % 2 = 0 AS b_hit FROM orders")
def paired_full_outer(t: Tables) -> DataFrame:
    return evaluate.matched(*_runs(t))


@query(f"WITH {_PAIRS} SELECT * FROM ct")
def paired_contingency(t: Tables) -> DataFrame:
    return evaluate.contingency(evaluate.matched(*_runs(t)))


@query(f"WITH {_PAIRS} SELECT *, round((b_only - a_only) / n, 6) AS delta, round({sql_mcnemar('a_only', 'b_only')}, 8) AS p_value, round({sql_log_mcnemar('a_only', 'b_only')}, 6) AS log_p FROM ct")
def paired_compare(t: Tables) -> DataFrame:
    return evaluate.compared(evaluate.matched(*_runs(t)))


@query(f"SELECT l_suppkey, CASE WHEN a + b = 0 THEN 'nothing to test' WHEN {sql_mcnemar('a', 'b')} >= 0.05 THEN 'nothing established' WHEN b > a THEN 'second better' ELSE 'first better' END AS verdict FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_quantity > 35) AS b FROM lineitem GROUP BY l_suppkey)")
def paired_verdict(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a_only"), F.count_if(F.col("l_quantity") > 35).alias("b_only"))
    return g.withColumn("p_value", stats.mcnemar("a_only", "b_only")).select("l_suppkey", evaluate.verdict().alias("verdict"))


@query("""WITH g AS (SELECT l_suppkey, sum(l_extendedprice) AS est, sum(l_extendedprice * (1 - l_discount)) AS act FROM lineitem GROUP BY ALL), r AS (SELECT *, round(act / est, 6) AS ratio FROM g)
SELECT count(*)::BIGINT AS n, min(ratio) AS lowest, max(ratio) AS highest, (SELECT min(l_suppkey) FROM r WHERE ratio = (SELECT min(ratio) FROM r)) AS cheapest, (SELECT min(l_suppkey) FROM r WHERE ratio = (SELECT max(ratio) FROM r)) AS dearest FROM r""")
def cost_error_ratio(t: Tables) -> DataFrame:
    """What was spent against what was estimated: the span, and who stands at its ends."""
    g = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("est"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("act"))
    r = g.select("l_suppkey", F.round(stats.ratio("act", "est"), 6).alias("ratio"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.min("ratio").alias("lowest"), F.max("ratio").alias("highest"), F.min_by("l_suppkey", F.struct("ratio", "l_suppkey")).alias("cheapest"), F.max_by("l_suppkey", F.struct("ratio", (-F.col("l_suppkey")).alias("s"))).alias("dearest"))


# ---------------------------------------------------------------- splits


@query("SELECT c_custkey::VARCHAR AS instance_id, c_nationkey AS \"group\", CASE WHEN pos <= cut THEN 'dev' ELSE 'test' END AS side, pos::BIGINT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7:' || c_custkey), c_custkey::VARCHAR) AS pos, round_even(count(*) OVER (PARTITION BY c_nationkey) * 0.5, 0) AS cut FROM customer)")
def stratified_split(t: Tables) -> DataFrame:
    return splits.stratified(t.customer.select(F.col("c_custkey").cast("string").alias("instance_id"), F.col("c_nationkey").alias("group")), 7)


@query("""WITH g AS (SELECT c_nationkey AS "group", count(*)::BIGINT AS n FROM customer GROUP BY ALL), p AS (SELECT sum(n)::BIGINT AS pool FROM g), e AS (SELECT "group", n, least(n, (70 * n) // pool) AS whole, (70 * n) % pool AS rest FROM g, p),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN whole < n THEN 0 ELSE 1 END, rest DESC, "group") AS k, 70 - sum(whole) OVER () AS spare FROM e) SELECT "group", n, (whole + CASE WHEN whole < n AND k <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def largest_remainder(t: Tables) -> DataFrame:
    g = t.customer.groupBy(F.col("c_nationkey").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return splits.largest_remainder(g, 70)


_SIDE = "CASE o_orderstatus WHEN 'O' THEN 'dev' WHEN 'F' THEN 'test' ELSE 'ci' END"


@query(f"WITH s AS (SELECT DISTINCT o_custkey AS k, {_SIDE} AS side FROM orders) SELECT (SELECT count(*) FROM (SELECT k FROM s WHERE side = 'dev' INTERSECT SELECT k FROM s WHERE side = 'test'))::BIGINT AS overlap, (SELECT count(*) FROM (SELECT k FROM s WHERE side = 'ci' EXCEPT SELECT k FROM s WHERE side = 'dev'))::BIGINT AS stray")
def split_guards(t: Tables) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "O", "dev").when(F.col("o_orderstatus") == "F", "test").otherwise("ci")
    return splits.guard_counts(t.orders.select(F.col("o_custkey").alias("instance_id"), s.alias("side")))


# ---------------------------------------------------------------- budgets and agents


def _events(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("instance"), F.col("event_type").alias("tool"), F.abs("value").alias("cost"), F.get_json_object("props", "$.k").alias("path"))


@query("WITH r AS (SELECT event_id AS seq, count(*) FILTER (event_type = 'click') OVER w AS hits, round(sum(abs(value)) OVER w, 4) AS spent, round(sum(abs(value) / 2) OVER w, 4) AS elapsed, max(event_id) OVER () AS last FROM events WINDOW w AS (ORDER BY event_id)) SELECT seq, hits::BIGINT AS hits, spent, elapsed FROM r WHERE seq % 10 = 0 OR seq = last")
def running_progress(t: Tables) -> DataFrame:
    p = budget.progress(_events(t).select("seq", (F.col("tool") == "click").alias("hit"), "cost", (F.col("cost") / 2).alias("latency")))
    return p.select("seq", F.col("hits").cast("long").alias("hits"), F.round("spent", 4).alias("spent"), F.round("elapsed", 4).alias("elapsed"))


CAP = 500.0
_GATE = "g AS (SELECT event_id AS seq, coalesce(sum(CASE WHEN event_type <> 'view' THEN abs(value) ELSE 0 END) OVER w, 0) AS spent, coalesce(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER w, 0) AS calls, coalesce(sum(abs(value)) OVER w, 0) AS every FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"WITH {_GATE} SELECT min(seq) FILTER (calls > 0 AND round(spent + spent / calls, 6) > {CAP})::BIGINT AS first_refused, count(*) FILTER (calls > 0 AND round(spent + spent / calls, 6) > {CAP})::BIGINT AS refused FROM g")
def budget_gate_projected(t: Tables) -> DataFrame:
    g = budget.projected_gate(_events(t).select("seq", "cost", (F.col("tool") == "view").alias("cached")), CAP)
    return g.agg(F.min(F.when(F.col("refused"), F.col("seq"))).alias("first_refused"), F.count_if("refused").alias("refused"))


@query(f"WITH {_GATE} SELECT min(seq) FILTER (round(every, 6) >= {CAP})::BIGINT AS first_refused, count(*) FILTER (round(every, 6) >= {CAP})::BIGINT AS refused FROM g")
def budget_gate_spent(t: Tables) -> DataFrame:
    g = budget.spent_gate(_events(t).select("seq", "cost"), CAP)
    return g.agg(F.min(F.when(F.col("refused"), F.col("seq"))).alias("first_refused"), F.count_if("refused").alias("refused"))


@query("SELECT user_id AS instance, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8 AS run FROM events")
def instance_budget(t: Tables) -> DataFrame:
    return budget.instance_budget(_events(t).select("instance", "seq"), agent.MAX_CALLS)


@query("WITH c AS (SELECT user_id, count(*) AS calls FROM events GROUP BY user_id) SELECT list_sort(list(calls))[count(*) // 2 + 1]::BIGINT AS median, round(avg(calls), 1) AS mean, count(*) FILTER (calls >= 60)::BIGINT AS at_cap, count(*)::BIGINT AS n FROM c")
def call_distribution(t: Tables) -> DataFrame:
    return agent.call_stats(_events(t).groupBy("instance").agg(F.count(F.lit(1)).alias("calls")), 60)


_TOUCH = "ft AS (SELECT user_id AS instance, json_extract_string(props, '$.k') AS path, arg_min(event_type, event_id) AS tool FROM events GROUP BY ALL)"


@query(f"WITH {_TOUCH} SELECT * FROM ft")
def first_touch(t: Tables) -> DataFrame:
    return agent.first_touch(_events(t).select("instance", "seq", "tool", "path"))


@query(f"WITH {_TOUCH}, best AS (SELECT user_id AS instance, max(json_extract_string(props, '$.k')) AS path FROM events GROUP BY ALL), cr AS (SELECT tool, count(*) AS credits FROM ft JOIN best USING (instance, path) GROUP BY tool) SELECT e.tool, e.calls::BIGINT AS calls, coalesce(credits, 0)::BIGINT AS credits FROM (SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY ALL) e LEFT JOIN cr USING (tool)")
def tool_roster(t: Tables) -> DataFrame:
    e = _events(t)
    best = e.groupBy("instance").agg(F.max("path").alias("path"))
    return agent.roster(e.select("tool"), first_touch(t).join(best, ["instance", "path"]).select("tool"))


@query()
def agent_replay(t: Tables) -> DataFrame:
    """Users as instances, their events as recorded steps: a purchase submits, other events call a tool of that name."""
    e = _events(t).withColumn("path", F.concat(F.lit("pkg/"), "path", F.lit(".py")))
    tool = F.create_map(*(F.lit(x) for kv in (("view", "read_file"), ("click", "search_code"), ("signup", "file_outline"), ("purchase", agent.SUBMIT), ("error", "no_such_tool")) for x in kv))
    call = F.struct(F.element_at(tool, F.col("tool")).alias("name"), F.array("path").alias("paths"), F.lit(False).alias("rejected"), (F.col("cost") > 300).alias("truncated"))
    steps = e.select(F.col("instance").cast("string").alias("instance_id"), F.col("seq").cast("int").alias("seq"), F.lit("").alias("text"), (F.col("cost") / 1000).alias("cost"), (F.col("cost") / 10).alias("seconds"), F.array(call).alias("calls"))
    listed = e.groupBy(F.col("instance").cast("string").alias("instance_id")).agg(F.sort_array(F.collect_set("path")).alias("candidates")).select("instance_id", F.slice("candidates", 1, 20).alias("candidates"), F.lit("r").alias("corpus"))
    tree = e.where("cost > 5").select(F.lit("r").alias("corpus"), "path").distinct()
    r = agent.replay(steps, listed, tree)
    return r.select("instance_id", "stop", F.array_join("ranking", ",").alias("ranking"), "calls", "steps", "guardrail_retries", F.size("off_list").alias("n_off_list"), F.size("recalled").alias("n_recalled"), F.round("cost", 6).alias("cost"), "credited")


@query(f"WITH RECURSIVE {sql_windows(2048)}, f AS (SELECT md5(text) AS blob, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING min(lang) <> 'en') SELECT blob, (w - 1)::INT AS pos, CASE WHEN regexp_matches(s, '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM f JOIN win USING (doc_id)")
def index_incremental(t: Tables) -> DataFrame:
    """Vectors for the contents of all documents that the index, here of one language, does not have yet."""
    from rankeval.operators import chunking

    files = t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("blob")).agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    chunks = files.select("blob", F.posexplode(chunking.line_windows("text", 2048)).alias("pos", "text"))
    have = files.where("lang = 'en'").select("blob")
    new = dense.extend_index(files.select("blob"), have, chunks, dense.hashed_encoder())
    return new.select("blob", F.col("pos").cast("int").alias("pos"), F.round(F.sqrt(dense.dot("embedding", "embedding")), 4).alias("norm"))


#: Longest pair that a scorer reads, in tokens.
PAIR_LIMIT = 512


@query(f"""WITH {sql_bm25(_DOCS, _ITEMS)}, {_TOP}, tr AS (SELECT b.item_id, d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)),
p AS (SELECT r.query AS item_id, r.doc AS doc_id, r.rank, d.n_chars // 4 AS tokens, coalesce(tr.doc_id = r.doc, false) AS ok FROM ranked r JOIN documents d ON d.doc_id = r.doc LEFT JOIN tr ON tr.item_id = r.query AND tr.doc_id = r.doc WHERE r.rank <= 20),
m AS (SELECT 'short first' AS model, -tokens AS s, * FROM p UNION ALL SELECT 'as fused', -rank, * FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY model, item_id ORDER BY s DESC, doc_id) AS place FROM m)
SELECT model, count(*) FILTER (place = 1)::BIGINT AS n, count(*) FILTER (place = 1 AND ok)::BIGINT AS hits, sum(tokens)::BIGINT AS tokens, round(avg(tokens), 4) AS mean, {sql_quantile(0.5)} AS median, {sql_quantile(0.9)} AS p90, max(tokens)::BIGINT AS longest,
round(100.0 * avg((tokens > 512)::INT), 4) AS percent_over FROM o JOIN (SELECT model, list_sort(list(tokens::DOUBLE)) AS x, count(*) AS k FROM o GROUP BY model) USING (model) GROUP BY model, x, k""")
def reranker_bakeoff(t: Tables) -> DataFrame:
    """Two stand-in scorers over the same heads: first places that hold the truth, against the fused order, and pair lengths."""
    from rankeval.plans.text_queries import contains_join

    head, truth = _topk(t, 20).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank"), contains_join(t).withColumn("right", F.lit(True))
    pairs = head.join(truth, ["item_id", "doc_id"], "left").join(t.documents.select("doc_id", F.expr("n_chars div 4").alias("tokens")), "doc_id")
    models = F.explode(F.array(F.struct(F.lit("short first").alias("model"), (-F.col("tokens")).alias("score")), F.struct(F.lit("as fused").alias("model"), (-F.col("rank")).cast("long").alias("score")))).alias("m")
    scored = pairs.select("item_id", "doc_id", "tokens", "right", models).select("m.model", "m.score", "item_id", "doc_id", "tokens", "right")
    best = scored.groupBy("model", "item_id").agg(F.max_by(F.coalesce("right", F.lit(False)), F.struct("score", (-F.col("doc_id")).alias("d"))).alias("right"))
    lengths = scored.groupBy("model").agg(
        F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 4).alias("mean"), F.max("tokens").alias("longest"),
        F.round(100.0 * F.avg((F.col("tokens") > PAIR_LIMIT).cast("int")), 4).alias("percent_over"),
    )
    return best.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("hits")).join(lengths, "model").join(order.quantiles_exclusive(scored, "tokens", ["model"], {"median": 0.5, "p90": 0.9}), "model")


#: An encoder's batches: tokens and rows of one at most.
BATCH_TOKENS, BATCH_ROWS = 4096, 64


@query(f"""WITH RECURSIVE {sql_windows(2048)}, tk AS (SELECT length(s) // 4 AS t FROM win), tn AS (SELECT t, count(*) AS n FROM tk GROUP BY t), ti AS (SELECT t, n, row_number() OVER (ORDER BY t) AS i FROM tn),
fo AS (SELECT 0::BIGINT AS i, 0::BIGINT AS t, 0::BIGINT AS b, 0::BIGINT AS r, 0::BIGINT AS h, 0::BIGINT AS closed UNION ALL
SELECT z.i, z.t, z.b + z.new, CASE WHEN z.rest = 0 THEN z.r + z.n ELSE z.rest - (z.new - 1) * z.fit END, CASE WHEN z.rest = 0 THEN z.h + z.n * z.t ELSE (z.rest - (z.new - 1) * z.fit) * z.t END, 0 FROM
(SELECT y.*, ((y.rest + y.fit - 1) // y.fit)::BIGINT AS new FROM (SELECT x.*, x.n - least(x.n, x.free) AS rest FROM (SELECT ti.i, ti.t, ti.n, fo.b, fo.r, fo.h,
 CASE WHEN ti.t = 0 THEN {BATCH_ROWS} ELSE greatest(1, least({BATCH_ROWS}, {BATCH_TOKENS} // greatest(ti.t, 1))) END AS fit,
 CASE WHEN fo.r = 0 THEN CASE WHEN ti.t = 0 THEN {BATCH_ROWS} ELSE greatest(1, least({BATCH_ROWS}, {BATCH_TOKENS} // greatest(ti.t, 1))) END ELSE greatest(0, least({BATCH_ROWS} - fo.r, CASE WHEN ti.t = 0 THEN {BATCH_ROWS} ELSE ({BATCH_TOKENS} - fo.h) // ti.t END)) END AS free
 FROM fo JOIN ti ON ti.i = fo.i + 1) x) y) z)
SELECT count(*)::BIGINT AS chunks, sum(t)::BIGINT AS tokens, round(100.0 * avg((t > 256)::INT), 4) AS percent_over, round(100.0 * sum(greatest(0, t - 256)) / sum(t), 4) AS percent_dropped, (count(*) * 384 * 4)::BIGINT AS index_bytes,
(SELECT max(b) + 1 FROM fo)::BIGINT AS batches, round(count(*) / (SELECT max(b) + 1 FROM fo), 4) AS rows_each, round(sum(t) / (SELECT max(b) + 1 FROM fo), 4) AS tokens_each FROM tk""")
def bench_metrics(t: Tables) -> DataFrame:
    """Of windows as an encoder would see them: how many, how many are over its limit, the share of tokens cut off, and batches."""
    from rankeval.operators import batching, chunking

    w = t.documents.select("doc_id", F.posexplode(chunking.line_windows("text", 2048)).alias("pos", "w")).select(F.struct("doc_id", "pos").alias("id"), F.expr("length(w) div 4").alias("tokens"))
    all_ = w.agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"), F.round(100.0 * F.avg((F.col("tokens") > 256).cast("int")), 4).alias("percent_over"), F.round(100.0 * F.sum(F.greatest(F.lit(0), F.col("tokens") - 256)) / F.sum("tokens"), 4).alias("percent_dropped"), (F.count(F.lit(1)) * 384 * 4).alias("index_bytes"))
    held = batching.rates(batching.batched(w, key="id", tokens="tokens", budget=BATCH_TOKENS, most=BATCH_ROWS), "tokens")
    return order.beside(all_, held.select("batches", "rows_each", "tokens_each"), [])
