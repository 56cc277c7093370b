"""Line dedup with DataFrame operations alone.

Lines are exploded, their keys hashed to 128 bits, and per hash the smallest document and whether there is a second one
are aggregated (partial sums first, so a line that a third of all documents hold costs one row a task). Each line then
learns its fate: hashes that hold more than one of HOT_SHARE lines are fewer than HOT_SHARE by arithmetic, so these are
broadcast and their lines stay where they are; the lines of all others meet their hash by a sort-merge join, none of
whose keys has more than that share of the rows. Texts are cut by position.

Defined results: null and empty texts are one empty line; a key under min_chars code points is never dropped; of
documents that tie for a line the one with the smallest id keeps it, on each of its lines; equal rows (same id, same
text) are cut alike; rows that share an id are one document; null ids are together one document, which comes after all
others; a very long text is exploded like others and put together again in one row; empty tables give empty tables;
further columns are kept by dedup_lines(), whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import staged, table

#: `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: A line is hot if more than one of so many is like it; less than this many can be.
HOT_SHARE = 2000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_hash, positions): the 0-based positions of the lines that go, of the rows that lose any."""
    lines = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    # A key can't have more characters than its line: short lines go before they are normalised.
    lines = lines.where(F.length("line") >= min_chars).select("id", "text_hash", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    lines = staged(lines.select("id", "text_hash", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2")), "lines")
    held = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("no_id"), F.count(F.lit(1)).alias("n"))
    shared = (F.col("first") != F.col("last")) | (F.col("no_id") & F.col("first").isNotNull())
    hot = F.col("n") * HOT_SHARE > lines.count()
    held = staged(held.select("h1", "h2", "first", shared.alias("shared"), hot.alias("hot")).where("shared or hot"), "held")
    hot = F.broadcast(held.where("hot").select("h1", "h2", F.col("first").alias("hot_first"), F.col("shared").alias("hot_shared")))
    told = lines.join(hot, ["h1", "h2"], "left")
    here = told.where("hot_shared").select("id", "text_hash", "pos", F.col("hot_first").alias("first"))
    there = told.where("hot_shared is null").join(held.where("not hot"), ["h1", "h2"]).select("id", "text_hash", "pos", "first")
    gone = here.unionByName(there).where(~F.col("id").eqNullSafe(F.col("first")))
    return gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, counts: bool = True, emptied: bool = True) -> DataFrame:
    """docs with the lines gone from text and, with counts, `n_lines` and `n_dropped` added (in place of columns so named).

    Without emptied, rows that lost lines and are left with blank ones alone go too.
    """
    gone = dropped_lines(docs, key=key, text=text, min_chars=min_chars)
    d, g = docs.alias("d"), gone.alias("g")
    both = d.join(g, F.col(f"d.{key}").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("g.text_hash")), "left")
    lines, positions = _lines(F.col(f"d.{text}")), F.col("g.positions")
    n_lines = F.size(lines)
    n_dropped = F.when(positions.isNull(), 0).otherwise(F.size(positions))
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), positions)
    # The lines are bound once by the outer lambda; the inner one only picks.
    picked = F.transform(F.array(lines), lambda all_: F.array_join(F.transform(kept, lambda p: F.get(all_, p)), "\n"))
    new = F.when(positions.isNull(), F.col(f"d.{text}")).otherwise(F.element_at(picked, 1))
    if not emptied:
        both = both.where(positions.isNull() | (F.btrim(new, F.lit(BLANKS)) != ""))
    added = {"n_lines": n_lines.cast("long"), "n_dropped": n_dropped.cast("long")} if counts else {}
    return both.select(*(new.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns if c not in added), *(v.alias(c) for c, v in added.items()))


def op9(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.*, h.first IS NOT NULL AND h.first <> k.doc_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
