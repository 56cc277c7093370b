"""Queries over text, paths and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.functions import order, patches, stats, text
from rankeval.operators import chunking, evaluate, ranking, sampling, tools
from rankeval.operators.literal import literal_hits
from rankeval.plans.base import SQL_LINES, SQL_PATH, Tables, order_paths, part_path, query, sql_is_source, sql_is_test, sql_norm, sql_quantile, sql_tokens, sql_windows
from rankeval.sources import cache, dataset, tree

#: Identifiers in every form that the tokenizer takes apart; the synthetic documents have none.
NAMES = ("separability_matrix", "HttpRequest", "django.db.models", "HTTPServer", "get_user_name", "parseXMLFile2", "for i in x", "ABc", "a1B2", "__init__", "")


@query(f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens, md5(array_to_string({sql_tokens('text')}, ' ')) AS tokens FROM documents")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.tokenize("text").alias("x")).select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.md5(F.array_join("x", " ").cast("binary")).alias("tokens"))


@query(f"SELECT name, array_to_string({sql_tokens('name')}, ' ') AS tokens FROM (SELECT unnest({list(NAMES)}) AS name UNION ALL SELECT p_name FROM part UNION ALL SELECT {SQL_PATH} FROM part)")
def tokenize_identifiers(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(n,) for n in NAMES], "name string").union(t.part.select("p_name")).union(t.part.select(part_path()))
    return names.select("name", F.array_join(text.tokenize("name"), " ").alias("tokens"))


@query(f"SELECT page_id, array_to_string(list_concat({sql_tokens('url')}, [lower(url)]), ' ') AS tokens FROM pages")
def tokenize_path(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(text.tokenize_path("url"), " ").alias("tokens"))


@query(rf"SELECT page_id, {sql_norm('url')} AS plain, {sql_norm(chr(39) + '././/' + chr(39) + r" || replace(url, '/', '\')")} AS odd FROM pages")
def normalize_path(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.normalize_path("url").alias("plain"), text.normalize_path(F.concat(F.lit("././/"), F.translate("url", "/", "\\"))).alias("odd"))


@query(f"SELECT p_partkey, path, {sql_is_source('path')} AS is_source, {sql_is_test('path')} AS is_test FROM (SELECT p_partkey, {SQL_PATH} AS path FROM part)")
def source_predicate(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", part_path().alias("path")).select("p_partkey", "path", text.is_source("path").alias("is_source"), text.is_test_path("path").alias("is_test"))


@query(f"SELECT p_brand, count(*)::BIGINT AS n, min(path) AS first FROM (SELECT p_brand, {SQL_PATH} AS path FROM part) WHERE {sql_is_source('path')} GROUP BY p_brand")
def source_files(t: Tables) -> DataFrame:
    return tree.source_files(t.part.select("p_brand", part_path().alias("path"))).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


@query("SELECT page_id, regexp_full_match(s, '[0-9a-f]{40}') AS valid FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN md5(url) || substr(md5(html), 1, 8) WHEN 1 THEN upper(md5(url) || substr(md5(html), 1, 8)) WHEN 2 THEN md5(url) ELSE md5(url) || 'x1234567' END AS s FROM pages)")
def valid_sha(t: Tables) -> DataFrame:
    u, h = F.md5(F.col("url").cast("binary")), F.substring(F.md5(F.col("html").cast("binary")), 1, 8)
    k = F.col("page_id") % 4
    return t.pages.select("page_id", text.valid_sha(F.when(k == 0, F.concat(u, h)).when(k == 1, F.upper(F.concat(u, h))).when(k == 2, u).otherwise(F.concat(u, F.lit("x1234567")))).alias("valid"))


def _patches(t: Tables) -> DataFrame:
    """(o, patch): a patch over the files of each order's lines."""
    lines = order_paths(t).groupBy("o").agg(F.sort_array(F.collect_list(F.struct("n", "path"))).alias("l"))
    return lines.select("o", F.array_join(F.transform("l", lambda x: F.concat(F.lit("diff --git a/"), x["path"], F.lit(" b/"), x["path"], F.lit("\n--- a\n+++ b\n"))), "").alias("patch"))


_PATCHES = f"{SQL_LINES}, p AS (SELECT o, string_agg('diff --git a/' || path || ' b/' || path || chr(10) || '--- a' || chr(10) || '+++ b' || chr(10), '' ORDER BY n, path) AS patch FROM lines GROUP BY o)"
_FILES = f"{_PATCHES}, raw AS (SELECT o, regexp_extract_all(patch, '(?m)^diff --git a/(.+?) b/(.+)$', 2) AS fs FROM p), x AS (SELECT o, unnest(fs) AS path, generate_subscripts(fs, 1) AS i FROM raw)"
_KEPT = f"{_FILES}, u AS (SELECT o, path, min(i) AS i FROM x WHERE {sql_is_source('path')} GROUP BY o, path), k AS (SELECT raw.o, count(u.path) AS n, coalesce(string_agg(u.path, ',' ORDER BY u.i), '') AS files FROM raw LEFT JOIN u ON raw.o = u.o GROUP BY raw.o), r AS (SELECT o, files, CASE WHEN n = 0 THEN 'no_source_files' WHEN n > 3 THEN 'too_many_source_files' END AS reason FROM k)"


@query(f"WITH {_PATCHES} SELECT o, len(fs)::BIGINT AS n, array_to_string(fs, ',') AS files FROM (SELECT o, regexp_extract_all(patch, '(?m)^diff --git a/(.+?) b/(.+)$', 2) AS fs FROM p)")
def patch_files(t: Tables) -> DataFrame:
    return _patches(t).select("o", patches.changed_files("patch").alias("f")).select("o", F.size("f").cast("long").alias("n"), F.array_join("f", ",").alias("files"))


def _classified(t: Tables) -> DataFrame:
    row = _patches(t).select(F.col("o").cast("string").alias("instance_id"), F.lit("r").alias("repo"), F.lit("0" * 40).alias("base_commit"), F.lit("").alias("problem_statement"), "patch")
    return dataset.classified(row)


@query(f"WITH {_KEPT} SELECT o::VARCHAR AS instance_id, files, reason FROM r")
def instance_filter(t: Tables) -> DataFrame:
    return _classified(t).select("instance_id", F.array_join("files", ",").alias("files"), "reason")


@query(f"WITH {_KEPT} SELECT count(*)::BIGINT AS total, count(*) FILTER (reason IS NULL)::BIGINT AS kept, round(count(reason) / count(*), 6) AS filter_rate, count(*) FILTER (reason = 'no_source_files')::BIGINT AS no_source_files, count(*) FILTER (reason = 'too_many_source_files')::BIGINT AS too_many_source_files FROM r")
def load_report(t: Tables) -> DataFrame:
    return dataset.load_report(_classified(t))


_REPORT = "'ValueError: ' || p_name || ' is not ' || p_type || '.' || chr(10) || 'see ' || p || ' line ' || p_size || ', get_' || lower(p_brand[1:5]) || '_name in django.db.Model' || p_size || ' or HttpRequestBody; KeyError:  x' || chr(10) || 'pkg/core/mod' || p_size || '.py and v1.2.3, KeyWarning: ' || chr(34) || p_type || ' went wrong' || chr(34)"


@query(rf"""WITH r AS (SELECT p_partkey, {_REPORT} AS t FROM (SELECT *, {SQL_PATH} AS p FROM part)),
m AS (SELECT p_partkey, list_filter(list_transform(list_filter(list_transform(regexp_extract_all(t, '\b\w*(?:Error|Exception|Warning)\b\s*:\s*([^\n]+)', 1), lambda x: trim(x)), lambda x: length(x) >= 8), lambda x: trim(x, '`"''.')), lambda x: length(x) >= 8) AS e,
list_filter(regexp_extract_all(t, '\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b'), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '\.(py|pyx|pxd|c|cc|cpp|h|js)$')) AS d,
list_filter(list_concat(regexp_extract_all(t, '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b'), regexp_extract_all(t, '\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b')), lambda x: length(x) >= 4) AS i,
regexp_extract_all(t, '\b[\w][\w./-]*\.(?:py|pyx|pxd|c|cc|cpp|h|js)\b') AS p FROM r)
SELECT p_partkey, {', '.join(f"array_to_string(list_filter({c}, lambda x, k: list_position({c}, x) = k)[1:10], '|') AS {n}" for c, n in (('e', 'error_strings'), ('d', 'dotted_names'), ('i', 'identifiers'), ('p', 'traceback_paths')))} FROM m""")
def issue_patterns(t: Tables) -> DataFrame:
    lit = F.lit
    report = F.concat(
        lit("ValueError: "), "p_name", lit(" is not "), "p_type", lit(".\nsee "), part_path(), lit(" line "), F.col("p_size").cast("string"), lit(", get_"), F.lower(F.substring("p_brand", 1, 5)), lit("_name in django.db.Model"), F.col("p_size").cast("string"),
        lit(" or HttpRequestBody; KeyError:  x\npkg/core/mod"), F.col("p_size").cast("string"), lit('.py and v1.2.3, KeyWarning: "'), "p_type", lit(' went wrong"'),
    )
    p = t.part.select("p_partkey", text.issue_patterns(report).alias("p"))
    return p.select("p_partkey", *(F.array_join(f"p.{k}", "|").alias(k) for k in ("error_strings", "dotted_names", "identifiers", "traceback_paths")))


@query("SELECT event_id, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS took FROM (SELECT event_id, floor(abs(value) * 3)::BIGINT AS s FROM events)")
def format_duration(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.format_duration(F.abs("value") * 3).alias("took"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l WHERE i <= 200)
SELECT doc_id, count(*) FILTER (used <= 4000)::BIGINT AS kept, coalesce(sum(length(x)) FILTER (used <= 4000), 0)::BIGINT AS chars FROM r GROUP BY doc_id""")
def prefix_char_cap(t: Tables) -> DataFrame:
    kept = text.first_lines_within(F.split("text", "\n", -1), tools.MAX_LINES, tools.MAX_CHARS)
    return t.documents.select("doc_id", kept.alias("k")).select("doc_id", F.size("k").cast("long").alias("kept"), F.length(F.array_join("k", "")).cast("long").alias("chars"))


def _doc_files(t: Tables) -> DataFrame:
    """(corpus, path, blob, text) of all documents."""
    return t.documents.select(F.col("lang").alias("corpus"), F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.md5(F.col("text").cast("binary")).alias("blob"), "text")


@query(r"""WITH f AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS l FROM documents),
x AS (SELECT doc_id, unnest(l[2:5]) AS x, generate_subscripts(l[2:5], 1) AS i FROM f),
r AS (SELECT doc_id, i, CASE WHEN i < 999999 THEN lpad((i + 1)::VARCHAR, 6, ' ') ELSE (i + 1)::VARCHAR END || '  ' || x AS w, sum(length(x) + 9) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM x),
b AS (SELECT doc_id, string_agg(w, chr(10) ORDER BY i) FILTER (used <= 4000) AS body, bool_or(used > 4000) AS truncated FROM r GROUP BY doc_id)
SELECT f.doc_id AS request, len(l)::BIGINT AS lines, coalesce(body, '') AS body, coalesce(truncated, false) AS truncated, len(l) < 2 AS rejected FROM f LEFT JOIN b ON f.doc_id = b.doc_id""")
def read_range(t: Tables) -> DataFrame:
    """Lines 2 to 5 of every document; cut where they are too long, rejected where there is no second line."""
    files = _doc_files(t)
    wanted = t.documents.select(F.col("doc_id").alias("request"), F.col("lang").alias("corpus"), F.concat(F.lit("./src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit(2).alias("first"), F.lit(5).alias("last"))
    return tools.read_range(wanted, files).select("request", "lines", F.coalesce("body", F.lit("")).alias("body"), "truncated", "rejected")


GREP = ("the", "Licensed under", "der", "no such text", "idiot", "%")


@query(f"""WITH p AS (SELECT unnest({list(GREP)}) AS pattern), h AS (SELECT pattern, 'src/' || source || '/' || doc_id || '.py' AS path FROM documents, p WHERE contains(text, pattern))
SELECT pattern, path, count(*) OVER (PARTITION BY pattern)::BIGINT AS hits, row_number() OVER (PARTITION BY pattern ORDER BY path) <= 30 AS shown FROM h""")
def grep_literal(t: Tables) -> DataFrame:
    files = _doc_files(t).withColumn("corpus", F.lit("all"))
    wanted = t.spark.createDataFrame([(g, "all", g) for g in GREP], "request string, corpus string, pattern string")
    return tools.grep(files.select("corpus", "path", "blob"), files.select("blob", "text"), wanted, store=t.store("blob-grams", t.documents)).withColumnRenamed("request", "pattern")


@query(f"SELECT doc_id, md5(text) AS blob, len({sql_tokens('text')})::BIGINT AS n_tokens FROM documents")
def blob_dedup_join(t: Tables) -> DataFrame:
    """Each distinct content is tokenized once, then joined to all that share it."""
    files = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("blob"), "text")
    once = tree.wanted_blobs(files.select("blob"), files.groupBy("blob").agg(F.first("text").alias("text"))).select("blob", F.size(text.tokenize("text")).cast("long").alias("n_tokens"))
    return files.select("doc_id", "blob").join(once, "blob").select("doc_id", "blob", "n_tokens")


@query("SELECT b.item_id, d.doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def contains_join(t: Tables) -> DataFrame:
    """Documents that share the rarest pieces of an item are looked at; hits then meet the items by their text."""
    items = t.benchmark.select("item_id", F.col("text").alias("pattern"))
    return literal_hits(t.documents, items, key="doc_id", store=t.store("document-grams", t.documents)).join(items, "pattern").select("item_id", "doc_id")


@query("""WITH h AS (SELECT b.item_id, d.lang, count(*) AS n FROM benchmark b, documents d WHERE contains(d.text, b.text) GROUP BY ALL),
i AS (SELECT b.item_id, coalesce(sum(n), 0) AS n FROM benchmark b LEFT JOIN h ON b.item_id = h.item_id GROUP BY b.item_id)
SELECT count(*)::BIGINT AS items, count(*) FILTER (n > 0)::BIGINT AS reached, count(*) FILTER (n BETWEEN 1 AND 30)::BIGINT AS within_cap, round(100.0 * count(*) FILTER (n > 0) / count(*), 4) AS percent FROM i""")
def reachability(t: Tables) -> DataFrame:
    """How many items are found at all, and by few enough hits to look at."""
    n = contains_join(t).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    each = t.benchmark.select("item_id").join(n, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reached = F.count_if(F.col("n") > 0)
    return each.agg(F.count(F.lit(1)).alias("items"), reached.alias("reached"), F.count_if(F.col("n").between(1, tools.MAX_HITS)).alias("within_cap"), F.round(100.0 * stats.ratio(reached, F.count(F.lit(1))), 4).alias("percent"))


@query("SELECT lang, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest, count(DISTINCT md5(text))::BIGINT AS blobs, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY lang")
def corpus_stats(t: Tables) -> DataFrame:
    d = t.documents.select("lang", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("blob"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"), F.max("n").alias("longest"), F.count_distinct("blob").alias("blobs"), F.sum(F.expr("n div 4")).alias("tokens"))


@query(f"WITH g AS (SELECT source, list_sort(list((n_chars // 4)::DOUBLE)) AS x, count(*) AS k, avg(n_chars // 4) AS mean FROM documents GROUP BY source) SELECT source, round(mean, 4) AS mean, round({sql_quantile(0.5)}, 4) AS median, round({sql_quantile(0.9)}, 4) AS p90 FROM g")
def quantiles_exclusive(t: Tables) -> DataFrame:
    d = t.documents.select("source", F.expr("n_chars div 4").alias("x"))
    mean = d.groupBy("source").agg(F.round(F.avg("x"), 4).alias("mean"))
    q = order.quantiles_exclusive(d, "x", ["source"], {"median": 0.5, "p90": 0.9})
    return order.beside(mean, q, ["source"]).select("source", "mean", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


@query(f"""WITH {SQL_LINES} SELECT o, md5(string_agg('### ' || path || chr(10) || CASE WHEN flag = 'N' THEN '(no snippet available)' ELSE flag || n END, chr(10) || chr(10) ORDER BY n, path, CASE WHEN flag = 'N' THEN '' ELSE flag || n END)) AS prompt FROM lines GROUP BY o""")
def render_prompt(t: Tables) -> DataFrame:
    snippet = F.when(F.col("flag") == "N", F.lit("")).otherwise(F.concat("flag", F.col("n").cast("string")))
    g = order_paths(t).groupBy("o").agg(F.sort_array(F.collect_list(F.struct("n", "path", snippet.alias("snippet")))).alias("c"))
    return g.select("o", F.md5(ranking.rendered_candidates(F.col("c")).cast("binary")).alias("prompt"))


def _requests(t: Tables) -> DataFrame:
    return t.conversations.where("role != 'assistant'").select("conv_id", "turn", cache.cache_key(F.lit("model-a"), F.col("text")).alias("key"))


def _responses(t: Tables) -> DataFrame:
    """What was said to each user turn, by the turn's key; two users who say the same share a key."""
    c = t.conversations
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    r = c.where("role = 'user'").select("conv_id", "turn", "text").join(said, ["conv_id", "turn"])
    return r.select(cache.cache_key(F.lit("model-a"), F.col("text")).alias("key"), F.col("reply").alias("text"), (F.length("reply") / 1000.0).alias("cost"))


_KEY = "sha256('[\"model-a\"],' || to_json([{}])::VARCHAR)"
_CACHE = f"""rs AS (SELECT {_KEY.format('u.text')} AS key, max((a.text, length(a.text) / 1000.0)) AS r FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE u.role = 'user' AND a.role = 'assistant' GROUP BY 1),
rq AS (SELECT conv_id, turn, {_KEY.format('text')} AS key FROM conversations WHERE role <> 'assistant'),
h AS (SELECT rq.*, r[1] AS text, r[2] AS cost, r IS NOT NULL AS cached FROM rq LEFT JOIN rs ON rq.key = rs.key)"""


@query(f"WITH {_CACHE} SELECT conv_id, turn, key, md5(text) AS reply, cost::DOUBLE AS cost, cached FROM h")
def response_cache_lookup(t: Tables) -> DataFrame:
    r = cache.lookup(_requests(t), _responses(t))
    return r.select("conv_id", "turn", "key", F.md5(F.col("text").cast("binary")).alias("reply"), F.col("cost").cast("double").alias("cost"), "cached")


@query(f"WITH {_CACHE} SELECT count(*) FILTER (NOT cached)::BIGINT AS calls, count(*) FILTER (cached)::BIGINT AS cache_hits, round(coalesce(sum(0.001 * turn) FILTER (NOT cached), 0), 6)::DOUBLE AS spent, count(*) FILTER (turn > 4)::BIGINT AS unparseable, count(*) FILTER (turn = 6)::BIGINT AS truncated, sum(turn)::BIGINT AS off_list FROM h")
def reply_counters(t: Tables) -> DataFrame:
    r = cache.lookup(_requests(t), _responses(t)).withColumn("cost", 0.001 * F.col("turn"))
    return cache.counters(r.withColumns({"unparseable": F.col("turn") > 4, "finish_reason": F.when(F.col("turn") == 6, "length").otherwise("stop"), "off_list": F.col("turn")}))


_CODE = "'class C' || p_partkey || '(Base):' || chr(10) || '    ' || repeat(chr(34), 3) || p_type || repeat(chr(34), 3) || chr(10) || '    x = ' || p_size || chr(10) || '    @wraps' || chr(10) || '    async def m' || p_size || '(self, a: int=1) -> str:' || chr(10) || '        return a' || chr(10) || 'if x:' || chr(10) || '    def hidden(): pass' || chr(10)"


def python_sources(t: Tables) -> DataFrame:
    """(blob, text): a Python source made of each part."""
    lit, key, size = F.lit, F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return t.part.select(F.col("p_partkey").alias("blob"), F.concat(lit("class C"), key, lit('(Base):\n    """'), "p_type", lit('"""\n    x = '), size, lit("\n    @wraps\n    async def m"), size, lit("(self, a: int=1) -> str:\n        return a\nif x:\n    def hidden(): pass\n")).alias("text"))


@query(r"""SELECT p_partkey AS blob, 0 AS pos, 'C' || p_partkey AS name, 'class' AS kind, 'class C' || p_partkey || '(Base)' AS signature, p_type AS docstring, 1 AS line,
md5('class C' || p_partkey || '(Base):' || chr(10) || '    ' || repeat('"', 3) || p_type || repeat('"', 3) || chr(10) || '    x = ' || p_size || chr(10) || '    @wraps') AS content FROM part UNION ALL
SELECT p_partkey, 1, 'C' || p_partkey || '.m' || p_size, 'function', 'def C' || p_partkey || '.m' || p_size || '(self, a: int=1) -> str', '', 5, md5('    async def m' || p_size || '(self, a: int=1) -> str:' || chr(10) || '        return a') FROM part""")
def ast_chunks(t: Tables) -> DataFrame:
    c = chunking.chunked(python_sources(t), bodies=True)
    return c.select("blob", "pos", "name", "kind", "signature", "docstring", "line", F.md5(F.col("content").cast("binary")).alias("content"))


@query("SELECT p_partkey AS blob, 'C' || p_partkey AS name, 1 AS line FROM part UNION ALL SELECT p_partkey, 'C' || p_partkey || '.m' || p_size, 5 FROM part")
def definitions(t: Tables) -> DataFrame:
    return chunking.definitions(python_sources(t)).select("blob", "name", "line")


@query(f"WITH RECURSIVE {sql_windows(512)} SELECT d.doc_id, count(w)::BIGINT AS n, max(length(s))::INT AS longest, md5(coalesce(string_agg(s, chr(1) ORDER BY w), '')) AS windows FROM documents d LEFT JOIN win ON win.doc_id = d.doc_id GROUP BY d.doc_id")
def line_windowing(t: Tables) -> DataFrame:
    """Windows of at most 512 characters, by a fold over the lines of each text."""
    w = t.documents.select("doc_id", chunking.line_windows("text", 512).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.array_max(F.transform("w", lambda x: F.length(x))).alias("longest"), F.md5(F.array_join("w", "\x01").cast("binary")).alias("windows"))


@query("SELECT c_custkey, c_name, ord FROM (SELECT c_custkey, c_name, c_nationkey * 1000000 + row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7:' || c_custkey), c_custkey::VARCHAR) AS ord, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7:' || c_custkey), c_custkey::VARCHAR) <= round_even(count(*) OVER (PARTITION BY c_nationkey) * 0.5, 0) AS dev FROM customer) WHERE dev")
def split_select(t: Tables) -> DataFrame:
    from rankeval.operators import splits

    rows = t.customer.select(F.col("c_custkey").cast("string").alias("instance_id"), "c_custkey", "c_name", F.col("c_nationkey").alias("group"))
    split = splits.stratified(rows, 7).withColumn("ord", F.col("group") * 1000000 + F.col("pos")).select("instance_id", "side", "ord")
    return splits.select_side(rows, split, "dev").select("c_custkey", "c_name", F.col("ord").cast("long").alias("ord"))


@query("SELECT * EXCLUDE (r) FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return evaluate.last_per_key(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('20260804:' || doc_id), doc_id LIMIT 100")
def uniform_sample(t: Tables) -> DataFrame:
    """A uniform sample of 100 documents, the same at every run: those of the smallest seeded hashes."""
    return t.documents.select("doc_id", "lang").orderBy(F.md5(F.concat(F.lit("20260804:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(100)


@query()
def reservoir_sample(t: Tables) -> DataFrame:
    """50 documents of each language, every set of them as likely as any other; the number of rows is all that SQL could tell."""
    return sampling.reservoir(t.documents.select("doc_id", "lang"), 50, seed=20260804, group="lang")
