"""The lookups an agent asks for, over a tree (corpus, path, blob) and blobs (blob, text), for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankeval.functions.text import existing_form, first_lines_within, is_source
from rankeval.operators.chunking import definitions
from rankeval.operators.literal import literal_hits

MAX_HITS, MAX_LINES, MAX_CHARS = 30, 200, 4000
#: What ends a line, here and where sources are cut into chunks.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _numbered(line: Column) -> Column:
    """A line's number, at least six characters wide."""
    n = line.cast("string")
    return F.when(F.length(n) < 6, F.lpad(n, 6, " ")).otherwise(n)


def grep(tree: DataFrame, blobs: DataFrame, patterns: DataFrame, limit: int = MAX_HITS, store: str | None = None) -> DataFrame:
    """(request, path, hits, shown): source files that hold the pattern literally, in tree order; binary ones never do.

    patterns: (request, corpus, pattern): blobs are searched once for all of them, before paths join; blobs may come more than
    once, as what is told of them is made distinct, not their texts. store: as in literal_hits().
    """
    found = literal_hits(blobs.where(~F.col("text").contains("\0")), patterns, key="blob", store=store).distinct()
    files = tree.where(is_source("path")).join(found, "blob").join(patterns, ["corpus", "pattern"]).select("request", "path")
    # Of a request's rows only the first are ordered; all others are compared with the last of these.
    by = Window.partitionBy("request").orderBy("path")
    first = files.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit).groupBy("request").agg(F.max("path").alias("bar"))
    same = files.groupBy("request", "path").agg(F.count(F.lit(1)).alias("same"))
    sizes = same.groupBy("request").agg(F.sum("same").alias("hits")).join(first, "request", "left")
    ahead = same.join(F.broadcast(first), "request").where(F.col("path") < F.col("bar")).groupBy("request").agg(F.sum("same").alias("ahead"))
    about = F.broadcast(sizes.join(ahead, "request", "left"))
    left = F.when(F.col("bar").isNull() | (F.col("path") > F.col("bar")), 0).when(F.col("path") < F.col("bar"), F.col("same")).otherwise(limit - F.coalesce("ahead", F.lit(0)))
    rows = same.join(about, "request").select("request", "path", "hits", left.alias("left"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))).alias("i"))
    return rows.select("request", "path", "hits", (F.col("i") <= F.col("left")).alias("shown"))


def read_range(requests: DataFrame, files: DataFrame, *, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(request, path, lines, body, truncated, rejected): numbered lines first..last of a file.

    requests: (request, corpus, path, first, last); files: (corpus, path, text). Unknown paths and empty or backward ranges
    are rejected.
    """
    r = requests.withColumn("path", existing_form("path")).join(files, ["corpus", "path"], "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(F.regexp_replace(text, f"({LINE_END})\\z", ""), LINE_END, -1)
    n = F.when(text == "", 0).otherwise(F.size(lines))
    bad = F.col("text").isNull() | (F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("first") > n)
    own = F.slice(lines, F.greatest(F.col("first"), F.lit(1)), F.greatest(F.lit(0), F.col("last") - F.col("first") + 1))
    own = F.slice(own, F.lit(1), F.greatest(F.lit(0), n - F.col("first") + 1))
    numbered = F.transform(own, lambda x, i: F.concat(_numbered(F.col("first") + i), F.lit("  "), x))
    r = r.select("request", "path", n.cast("long").alias("lines"), bad.alias("rejected"), F.when(~bad, numbered).alias("w"))
    r = r.withColumn("kept", first_lines_within(F.col("w"), max_lines, max_chars))
    return r.select("request", "path", "lines", F.array_join("kept", "\n").alias("body"), F.coalesce(F.size("kept") < F.size("w"), F.lit(False)).alias("truncated"), "rejected")


def outline(files: DataFrame) -> DataFrame:
    """(path, n, body): `line  signature` of each definition, cut to fit. files: (path, text)."""
    d = definitions(files, key="path").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "signature"))).alias("d"))
    body = F.transform("d", lambda x: F.concat(_numbered(x["line"]), F.lit("  "), x["signature"]))
    return d.select("path", F.size("d").alias("n"), F.array_join(first_lines_within(body, MAX_LINES, MAX_CHARS), "\n").alias("body"))


def find_definition(tree: DataFrame, blobs: DataFrame, symbols: DataFrame, store: str | None = None) -> DataFrame:
    """(request, path, line, signature) of definitions named by the symbol or ending in it. symbols: (request, corpus, symbol).

    Blobs without the symbol's last part are not parsed.
    """
    s = symbols.withColumn("pattern", F.substring_index("symbol", ".", -1))
    near = blobs.join(literal_hits(blobs, s, key="blob", store=store).select("blob").distinct(), "blob", "left_semi").select("blob", "text").distinct()
    d = definitions(near).select("blob", "name", "line", "signature")
    files = tree.where(is_source("path")).join(d, "blob")
    named = (F.col("name") == F.col("symbol")) | F.col("name").endswith(F.concat(F.lit("."), F.col("symbol")))
    # Equal last parts first, so that the join is by key.
    files = files.withColumn("pattern", F.substring_index("name", ".", -1))
    return files.join(s, ["corpus", "pattern"]).where(named).select("request", "path", "line", "signature")


def _requested(requests: DataFrame, tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """(corpus, path, text) of the files that are asked for. A file whose content is not there is no fault of who asks: the job fails."""
    wanted = requests.select("corpus", existing_form("path").alias("path")).distinct()
    held = tree.join(wanted, ["corpus", "path"], "left_semi").join(blobs.select("blob", "text", F.lit(True).alias("_held")), "blob", "left")
    lost = F.raise_error(F.concat(F.lit("content is missing: "), F.col("path")))
    return held.select("corpus", "path", F.when(F.col("_held"), F.coalesce("text", F.lit(""))).otherwise(lost).alias("text"))


def _answer(text: Column, paths: Column, truncated: Column, rejected: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    return [F.col("request"), text.alias("text"), F.coalesce(paths, none).alias("paths"), F.coalesce(truncated, F.lit(False)).alias("truncated"), rejected.alias("rejected")]


def _listed(requests: DataFrame, rows: DataFrame, nothing: str) -> DataFrame:
    """Answers from rows (request, at, path, line, more): the lines in the order of `at`, within the caps; a request without any is told so."""
    found = rows.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("at", "line", "path"))).alias("_l"), F.max("more").alias("more"))
    every = requests.select("request").join(found, "request", "left")
    lines = F.transform("_l", lambda x: x["line"])
    kept = first_lines_within(lines, MAX_LINES, MAX_CHARS)
    paths = F.array_distinct(F.transform(F.slice("_l", F.lit(1), F.size(kept)), lambda x: x["path"]))
    return every.select(*_answer(F.coalesce(F.array_join(kept, "\n"), F.lit(nothing)), paths, F.col("more") | (F.size(kept) < F.size(lines)), F.lit(False)))


def _read_file(requests: DataFrame, tree: DataFrame, blobs: DataFrame, store: str | None) -> DataFrame:
    r = read_range(requests, _requested(requests, tree, blobs))
    return r.select(*_answer(F.when(F.col("rejected"), F.lit("no such file or lines")).otherwise(F.col("body")), F.when(~F.col("rejected"), F.array("path")), F.col("truncated"), F.col("rejected")))


def _search_code(requests: DataFrame, tree: DataFrame, blobs: DataFrame, store: str | None) -> DataFrame:
    asked = requests.where(F.col("pattern") != "")
    hits = grep(tree, blobs, asked.select("request", "corpus", "pattern"), store=store).where("shown")
    found = _listed(asked, hits.select("request", F.lit(0).alias("at"), F.col("path").alias("line"), "path", (F.col("hits") > MAX_HITS).alias("more")), "no match")
    empty = requests.where(F.coalesce(F.col("pattern"), F.lit("")) == "").select(*_answer(F.lit("nothing to look for"), F.lit(None).cast("array<string>"), F.lit(False), F.lit(True)))
    return found.unionByName(empty)


def _file_outline(requests: DataFrame, tree: DataFrame, blobs: DataFrame, store: str | None) -> DataFrame:
    r = requests.withColumn("path", existing_form("path")).join(_requested(requests, tree, blobs), ["corpus", "path"], "left")
    lines = outline(r.where("text is not null").select(F.col("request").alias("path"), "text")).withColumnRenamed("path", "request")
    r = r.join(lines, "request", "left")
    unknown = F.col("text").isNull()
    body = F.when(unknown, F.lit("no such file")).otherwise(F.coalesce("body", F.lit("no definitions")))
    return r.select(*_answer(body, F.when(~unknown, F.array("path")), F.size(F.split("body", "\n", -1)) < F.col("n"), unknown))


def _find_definition(requests: DataFrame, tree: DataFrame, blobs: DataFrame, store: str | None) -> DataFrame:
    d = find_definition(tree, blobs, requests.select("request", "corpus", F.col("pattern").alias("symbol")), store=store)
    w = Window.partitionBy("request")
    at = F.row_number().over(w.orderBy("path", "line", "signature"))
    d = d.select("request", at.alias("at"), "path", F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit("  "), "signature").alias("line"), (F.count(F.lit(1)).over(w) > MAX_HITS).alias("more"))
    return _listed(requests, d.where(F.col("at") <= MAX_HITS), "no definition")


#: What an agent may call by name. Semantic search needs vectors: see dense.best_of().
TOOLBOX = {"read_file": _read_file, "search_code": _search_code, "file_outline": _file_outline, "find_definition": _find_definition}


def answers(requests: DataFrame, tree: DataFrame, blobs: DataFrame, store: str | None = None) -> DataFrame:
    """(request, text, paths, truncated, rejected): what the tools say to many requests at once, one row each.

    requests: (request string, corpus, tool, path, first, last, pattern), of which each tool takes its own; pattern is the
    symbol of find_definition. What the caller got wrong (a tool, path, range or pattern that is none) is a rejected
    answer; content that should be there and is not fails the job. Requests of one tool are answered together.
    """
    out = None
    for name, tool in TOOLBOX.items():
        part = tool(requests.where(F.col("tool") == name), tree, blobs, store)
        out = part if out is None else out.unionByName(part)
    others = requests.where(~F.coalesce(F.col("tool").isin(*TOOLBOX), F.lit(False)))
    return out.unionByName(others.select(*_answer(F.lit(f"no such tool; there are {', '.join(TOOLBOX)}"), F.lit(None).cast("array<string>"), F.lit(False), F.lit(True))))
