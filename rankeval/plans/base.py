"""What the registered queries share: the registry, table access, and stand-ins built alike in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankeval.session import ship
from rankeval.sources.store import shared_folder, signature

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """The tables below one folder, read when asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def store(self, name: str, *tables: DataFrame) -> str:
        """A folder for what is derived from tables: another one once their files change."""
        return f"{shared_folder(self.spark)}/{name}-{signature(*tables)}"


def query(sql: str | None = None):
    """Register f(tables) under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        CATALOG[f.__name__] = (run, sql)
        return f

    return add


#: Directories and suffixes of stand-in paths.
DIRS = ("src", "tests", "docs", "pkg/test", ".github", "lib/testing", "examples", "a/b/doc", "core")
ENDS = (".py", ".md", ".c", ".json", "_test.py", ".pyx", "")


def part_path() -> Column:
    """A path for each part."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    return F.concat(pick(DIRS, F.col("p_partkey")), F.lit("/"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), pick(ENDS, F.col("p_size")))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL_PATH = f"(({_sql_list(DIRS)})[p_partkey % {len(DIRS)} + 1] || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || ({_sql_list(ENDS)})[p_size % {len(ENDS)} + 1])"


def order_paths(t: Tables) -> DataFrame:
    """(o, n, path, flag, price): the lines of all orders with their parts' paths."""
    parts = t.part.select("p_partkey", part_path().alias("path"))
    return t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "path", F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))


SQL_LINES = f"lines AS (SELECT l_orderkey AS o, l_linenumber AS n, {SQL_PATH} AS path, l_returnflag AS flag, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey)"


def sql_norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\\/]+', '/', 'g'), '^/?(\./)*', '')"


def sql_is_test(p: str) -> str:
    return rf"(regexp_matches({p}, '(^|/)(tests|test|testing)/') OR regexp_matches({p}, '(^|/)test_[^/]*$') OR regexp_matches({p}, '_test\.py$'))"


def sql_is_source(p: str) -> str:
    return rf"NOT ({sql_is_test(p)} OR regexp_matches({p}, '(^|/)(docs|doc|\.github|examples|benchmarks)/') OR regexp_matches({p}, '(\.md|\.rst|\.txt|\.cfg|\.ini|\.toml|\.lock|\.json|\.yaml|\.yml)$'))"


def sql_tokens(x: str) -> str:
    parts = r"list_filter(list_transform(regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda p: lower(p)), lambda p: length(p) >= 2)"
    return f"flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9_]+'), lambda w: list_concat({parts}, CASE WHEN len({parts}) > 1 THEN [lower(w)] ELSE [] END)))"


def sql_wilson(h: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054"
    p, z2 = f"({h})::DOUBLE / ({n})", f"({z} * {z})"
    mid, half = f"({p} + {z2} / (2 * ({n})))", f"({z} * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4.0 * ({n}) * ({n}))))"
    return tuple(f"CASE WHEN ({n}) > 0 THEN least(1.0, greatest(0.0, ({mid} {s} {half}) / (1 + {z2} / ({n})))) ELSE 0.0 END" for s in "-+")  # type: ignore[return-value]


def sql_log_mcnemar(a: str, b: str) -> str:
    terms = f"list_transform(range(0, least({a}, {b}) + 1), lambda i: lgamma(({a}) + ({b}) + 1) - lgamma(i + 1) - lgamma(({a}) + ({b}) - i + 1) - (({a}) + ({b})) * ln(2))"
    last = f"lgamma(({a}) + ({b}) + 1) - lgamma(least({a}, {b}) + 1) - lgamma(greatest({a}, {b}) + 1) - (({a}) + ({b})) * ln(2)"  # the largest
    return f"CASE WHEN ({a}) = ({b}) THEN 0.0 ELSE least(0.0, ln(2) + ({last}) + ln(list_sum(list_transform({terms}, lambda x: exp(x - ({last})))))) END"


def sql_mcnemar(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) + ({b}) = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({a}, {b}) + 1), lambda i: exp(lgamma(({a}) + ({b}) + 1) - lgamma(i + 1) - lgamma(({a}) + ({b}) - i + 1) - (({a}) + ({b})) * ln(2))))) END"


def sql_quantile(p: float) -> str:
    """Of a sorted list x of k numbers."""
    return f"CASE WHEN k = 1 THEN x[1] ELSE x[greatest(1, least(k - 1, floor({p} * (k + 1))::INT))] * (1 - ({p} * (k + 1) - greatest(1, least(k - 1, floor({p} * (k + 1)))))) + x[greatest(1, least(k - 1, floor({p} * (k + 1))::INT)) + 1] * ({p} * (k + 1) - greatest(1, least(k - 1, floor({p} * (k + 1))))) END"


def sql_bm25(docs: str, queries: str, b: float = 0.75) -> str:
    """CTEs that end in s(query, doc, score); docs: SELECT doc, toks; queries: SELECT query, toks."""
    return f"""d AS ({docs}), q AS ({queries}),
tf AS (SELECT doc, t, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(toks) AS dl, unnest(toks) AS t FROM d) GROUP BY doc, t),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
raw AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), st),
idf AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qt AS (SELECT query, t, count(*) AS qtf FROM (SELECT query, unnest(toks) AS t FROM q) GROUP BY query, t),
s AS (SELECT query, doc, round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (t) JOIN tf USING (t), st GROUP BY query, doc)"""


def sql_windows(budget: int) -> str:
    """CTEs (to follow WITH RECURSIVE) that end in win(doc_id, w, s): line windows of the documents, w from 1."""
    return f"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS m FROM documents),
le AS (SELECT doc_id, i, CASE WHEN i < m THEN x || chr(10) ELSE x END AS x FROM ln),
pc AS (SELECT doc_id, i, j, substring(x, (j * {budget} + 1)::BIGINT, {budget}) AS s, length(x) <= {budget} AS joins FROM (SELECT *, unnest(range(0, (length(x) - 1) // {budget} + 1)) AS j FROM le WHERE x <> '')),
pn AS (SELECT doc_id, s, joins, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM pc),
wn AS (SELECT doc_id, k, 1::BIGINT AS w, length(s) AS size FROM pn WHERE k = 1 UNION ALL
SELECT p.doc_id, p.k, CASE WHEN p.joins AND wn.size + length(p.s) <= {budget} THEN wn.w ELSE wn.w + 1 END, CASE WHEN p.joins AND wn.size + length(p.s) <= {budget} THEN wn.size + length(p.s) ELSE length(p.s) END FROM wn JOIN pn p ON p.doc_id = wn.doc_id AND p.k = wn.k + 1),
win AS (SELECT doc_id, w, string_agg(s, '' ORDER BY k) AS s FROM wn JOIN pn USING (doc_id, k) GROUP BY doc_id, w)"""
