"""Quality rules as a ledger of bits, with DataFrame operations alone.

ledger() measures every text once and sets a bit for each rule that it fails; a policy is a versioned mask over the bits,
so policies are applied, compared and ablated on the ledger without another look at the texts.

Defined results: null and empty texts have no words, all measurements 0, and fail `few_words`; every row is judged by
itself, so ties, repeated rows and empty tables need nothing special; a very long text is measured whole, its windows
held in one row's array; further columns are ignored by ledger(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import table
from rankeval.llm.line_dedup import BLANKS

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: name -> condition on the measurements under which a text fails; the place is the bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars > 25 * n_words OR word_chars < 2 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: version -> rules that reject.
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "repeated_lines", "word_length")}


def mask_of(rules) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def _let(value: Column, body) -> Column:
    """body of value, which is computed once and not again for every element that body handles."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """The number of words inside windows that the text has twice or more."""

    def by_windows(h: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return _let(F.transform(first, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW)))), covered)

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(placed, repeated_places))

    def repeated_places(s: Column) -> Column:
        same = F.filter(s, lambda p, j: F.coalesce(p["x"] == F.get(s, j + 1)["x"], F.lit(False)) | F.coalesce(p["x"] == F.get(s, j - 1)["x"], F.lit(False)))
        return _let(F.sort_array(F.transform(same, lambda p: p["i"])), span)

    def span(at: Column) -> Column:
        own = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, 0).otherwise(_let(hashes, by_windows))


def ledger(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measurements (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) and the mask failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+", -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    measured = docs.select(
        F.col(key),
        F.length(F.translate(t, BLANKS, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeat"))).alias("words"),
    )
    measured = measured.select(
        key, F.col("words.n").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.repeat").cast("long").alias("n_repeat_words"),
    )
    return measured.withColumn("failed", sum((F.expr(rule).cast("int") * (1 << i) for i, rule in enumerate(RULES.values())), F.lit(0)))


def verdict(failed: Column, version: str) -> Column:
    """True where the policy keeps a text."""
    return failed.bitwiseAND(mask_of(POLICIES[version])) == 0


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of the policy: texts it fails, texts it alone rejects, and texts kept without it."""
    policy = mask_of(POLICIES[version])
    masks = rows.groupBy(F.col("failed").bitwiseAND(policy).alias("m")).count()  # at most 2 ** rules rows go on
    one = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(mask_of([name])).alias("bit")) for name in POLICIES[version])))
    hit = (F.col("m").bitwiseAND(F.col("bit")) != 0).cast("long")
    rest = (F.col("m").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).cast("long")
    each = masks.select("m", "count", one.alias("r")).select("m", "count", "r.rule", "r.bit")
    return each.groupBy("rule").agg(F.sum(hit * F.col("count")).alias("fails"), F.sum(hit * rest * F.col("count")).alias("alone"), F.sum(rest * F.col("count")).alias("kept_without"))


def op7(spark, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~verdict(F.col("failed"), "base")).alias("base_failed"), verdict(F.col("failed"), "v1").alias("kept"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM x WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
             (len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 40 * n_lines OR word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""
