import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rankeval.functions import order, patches, stats, text
from rankeval.operators import evaluate


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_tokenize(spark):
    cases = {
        "separability_matrix": ["separability", "matrix", "separability_matrix"], "HttpRequest": ["http", "request", "httprequest"], "HTTPServer": ["http", "server", "httpserver"], "for i in x": ["for", "in"],
        "django.db": ["django", "db"], "get_user_name x": ["get", "user", "name", "get_user_name"], "": [], None: [], "ab ab": ["ab", "ab"], "éab1": ["ab"],
    }
    assert column(spark, list(cases), text.tokenize) == list(cases.values())
    assert column(spark, ["astropy/Mod.py"], text.tokenize_path) == [["astropy", "mod", "py", "astropy/mod.py"]]


@pytest.mark.parametrize(
    "path,source",
    [("django/db/models/query.py", True), ("pandas/_libs/tslib.pyx", True), ("a/searchtools.js", True), ("./django/db/query.pyi", True), ("tests/test_query.py", False), ("pandas/core/test_frame.py", False), ("sympy/ode_test.py", False), ("README.md", False), ("docs/usage.py", False), ("./docs/usage.rst", False), (".github/workflows/ci.yml", False), ("package.json", False), ("latest/x.py", True), ("contest_data.py", True), ("a/testing/b.c", False), ("doc", True)],
)
def test_is_source(spark, path, source):
    assert column(spark, [path], text.is_source) == [source]


def test_paths_and_shas(spark):
    assert column(spark, ["./a//b.py", "/a\\b", "././x", "A/b", ""], text.normalize_path) == ["a/b.py", "a/b", "x", "A/b", ""]
    assert column(spark, [" ./a/b ", ".github/x"], text.existing_form) == ["a/b", "github/x"]
    assert column(spark, ["a" * 40, "A" * 40, "a" * 39, "g" * 40, "a" * 40 + "\n", None], text.valid_sha) == [True, False, False, False, False, False]


def test_issue_patterns(spark):
    report = "TypeError: unsupported operand for +\nsee django.db.models and pkg/core/mod.py, get_queryset, HttpResponse, naïve.name_x `1.11.3`\nValueError: short\nget_queryset"
    got = column(spark, [report], text.issue_patterns)[0]
    assert got.error_strings == ["unsupported operand for +"] and got.traceback_paths == ["pkg/core/mod.py"]
    assert got.dotted_names == ["django.db.models", "naïve.name_x"] and got.identifiers == ["get_queryset", "name_x", "TypeError", "HttpResponse", "ValueError"]
    many = column(spark, [" ".join(f"name_{i}x" for i in range(30))], text.issue_patterns)[0]
    assert len(many.identifiers) == 10


def test_reply_line_and_duration(spark):
    assert column(spark, ["- `pkg/a.py`", " 3. pkg/b.py ", "`pkg/c.py`", "* x"], text.reply_line) == ["`pkg/a.py", "pkg/b.py", "pkg/c.py", "x"]
    assert column(spark, ["59.9", "60", "3725"], lambda c: text.format_duration(c.cast("double"))) == ["59s", "1m 00s", "62m 05s"]


def test_first_lines_within(spark):
    df = spark.createDataFrame([(["aaaa", "bbbb", "c"],)], "l array<string>")
    take = lambda n, c: df.select(text.first_lines_within(F.col("l"), n, c)).first()[0]
    assert take(9, 10) == ["aaaa", "bbbb"] and take(1, 99) == ["aaaa"] and take(9, 3) == [] and take(9, 99) == ["aaaa", "bbbb", "c"]


def test_patches(spark):
    patch = "diff --git a/old.py b/pkg/new.py\n+x\ndiff --git a/a b c.py b/a b c.py\n diff --git a/n b/n\ndiff --git a/pkg/new.py b/pkg/new.py\n"
    assert column(spark, [patch, ""], patches.changed_files) == [["pkg/new.py", "a b c.py", "pkg/new.py"], []]
    files = column(spark, [patch], lambda c: patches.source_files(patches.changed_files(c)))[0]
    assert files == ["pkg/new.py", "a b c.py"]
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],), (["a", "b", "c", "d"],)], "f array<string>")
    assert [r[0] for r in df.select(patches.drop_reason(F.col("f"))).collect()] == ["no_source_files", None, None, "too_many_source_files"]


def test_wilson_and_mcnemar(spark):
    pairs = [(0, 0), (0, 16), (7, 7), (0, 1), (1, 5), (5, 1), (9, 19), (18, 22), (3000, 3100), (1, 2), (12, 13), (499, 501), (10, 3000), (0, 5000), (2500, 9000)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", stats.mcnemar("a", "b").alias("p"), stats.log_mcnemar("a", "b").alias("log_p")).collect()
    for r in got:
        n, ways = r.a + r.b, 2 * sum(math.comb(r.a + r.b, i) for i in range(min(r.a, r.b) + 1))
        exact = min(0.0, math.log(ways) - n * math.log(2)) if n else 0.0
        assert math.isclose(r.log_p, exact, rel_tol=1e-12, abs_tol=1e-11) and math.isclose(r.p, math.exp(exact), rel_tol=1e-8)
    assert math.isclose(got[4].p, 7 / 32)
    # Far beyond what can be counted out: against the normal law near the middle, against Chernoff's bound far from it.
    big = spark.createDataFrame([(500_000_000 - 10_000, 500_000_000 + 10_000), (10**9, 3 * 10**9), (0, 10**12)], "a long, b long")
    near, far, none = (r[0] for r in big.select(stats.log_mcnemar("a", "b")).collect())
    z = (20_000 - 1) / math.sqrt(10**9)
    assert math.isclose(math.exp(near), math.erfc(z / math.sqrt(2)), rel_tol=1e-6)
    chernoff = -4e9 * (math.log(2) + 0.25 * math.log(0.25) + 0.75 * math.log(0.75))
    assert chernoff - 20 < far < chernoff and math.isclose(none, (1 - 10**12) * math.log(2))
    ci = spark.createDataFrame([(0, 0), (5, 10), (10, 10), (50, 100)], "h long, n long").select(stats.wilson("h", "n").alias("c")).collect()
    low, high = [r.c.low for r in ci], [r.c.high for r in ci]
    assert (low[0], high[0]) == (0, 0) and low[1] < 0.5 < high[1] and 1 - 1e-12 < high[2] <= 1 and high[3] - low[3] < high[1] - low[1]


def test_medians_and_quantiles(spark):
    r = random.Random(4)
    groups = {"one": [3.0], "two": [1.0, 2.0], "four": [5.0, 1.0, 4.0, 2.0], None: list(map(float, range(37))), "same": [2.0] * 500 + [1.0, 9.0], "many": [round(r.gauss(0, 50), 1) for _ in range(3000)]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in [*values, None]] + [("none", None)], "g string, x double").repartition(7)
    med = {x.g: x["median"] for x in order.upper_median(df, "x", ["g"]).collect()}
    assert med == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    ex = {x.g: (x.q, x.h) for x in order.quantiles_exclusive(df, "x", ["g"], {"q": 0.9, "h": 0.5}).collect()}
    for g, v in groups.items():
        if len(v) > 1:
            assert math.isclose(ex[g][0], statistics.quantiles(v, n=10)[8]) and math.isclose(ex[g][1], statistics.quantiles(v, n=2)[0])
    assert ex["one"] == (3.0, 3.0)
    everything = sorted(v for values in groups.values() for v in values)
    assert order.upper_median(df, "x", []).first()[0] == everything[len(everything) // 2]
    assert order.upper_median(df.limit(0), "x", []).count() == 0
    rows = order.beside(df.groupBy("g").count(), order.upper_median(df, "x", ["g"]), ["g"])
    assert {x.g: x["median"] for x in rows.collect()} == med | {"none": None}


def test_no_group_is_collected(spark):
    scores = spark.createDataFrame([(1, "a", True, 1.0, 1.0, 1.0, 1.0)], "instance_id int, grp string, hit boolean, recall_3 double, recall_5 double, latency double, cost double")
    for df in (evaluate.overall(scores), evaluate.by_group(scores, "grp"), evaluate.report(scores, "grp")):
        assert "collect_list" not in df._jdf.queryExecution().toString()
