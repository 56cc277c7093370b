"""Secret scans as an incremental ledger of blobs, with DataFrame operations alone.

Every historical version of a text is addressed by its content (SHA-256). scan() takes from the history one text a blob and
finds what the ledger does not hold yet: pairs of a blob and a rule's version. Its rows are appended to the ledger, and
on_paths() joins findings back to every path and version that holds the blob. A new version of a rule is looked for in all
blobs, a new text is scanned by all rules, and nothing else is read twice.

Texts are shuffled once, by key and content, so that copies are dealt out over all tasks and all but one of them dropped
there; findings of blobs that many paths hold are joined with salt.

Defined results: a null text is the empty one; a null key is a key; equal rows, copies and versions of one path share
their blob's findings; of rows with one blob the smallest key is scanned; a very long text is matched whole, its findings
held in one row; empty tables give empty tables; on_paths() keeps further columns, whatever their names, but replaces
`blob` and `findings`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankeval.llm.common import HOT_SHARE, staged, table


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; with tail, those whose second group has so many characters at least.

    guard: a literal that every match holds, for a cheaper look first. New patterns need a new version.
    """

    name: str
    version: int
    pattern: str
    tail: int = 0
    guard: str = ""

    @property
    def id(self) -> str:
        return f"{self.name}/{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", 1, f"""({_NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", tail=6),
    # A run's shorter matches fail together with it, so the least length may stand in the pattern.
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", guard="AKIA"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: What the base rules do not see; repeats have upper bounds where a match may fail behind them.
RULES = (
    *BASE,
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]+-----END [A-Z ]{0,40}PRIVATE KEY-----", guard="PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,}", guard="eyJ"),
    Rule("bearer", 1, r"[Bb]earer\x20[A-Za-z0-9._~+/=-]{20,}", guard="earer "),
    Rule("login", 1, r"://[^\x00-\x20:@/]{1,256}:[^\x00-\x20:@/]{1,256}@", guard="://"),
    Rule("issued", 1, "gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35,}|[rs]k_live_[A-Za-z0-9]{16,}"),
)

SPAN = "struct<start: int, end: int>"
FINDING = "struct<rule: string, version: int, start: int, end: int>"
LEDGER = f"blob binary, scanned array<string>, findings array<{FINDING}>"
#: Matches whose places are summed up in one piece; arrays are copied as they grow.
PIECE = 256
#: Findings of a blob that more than one of HOT_SHARE rows holds are copied for so many salts.
SALTS = 64


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches, in code points, end exclusive, in their order."""
    none = F.array().cast(f"array<{SPAN}>")

    def placed(hits: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        holds = (lambda h: F.length(F.regexp_extract(h, rule.pattern, 2)) >= rule.tail) if rule.tail else (lambda h: F.lit(True))
        sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), holds(h).alias("holds")))
        return _let(sizes, located)

    def located(sizes: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PIECE).cast("int")), lambda i: F.slice(sizes, i * PIECE + 1, F.lit(PIECE)))
        start = lambda at, found: F.struct(at.alias("at"), found.alias("found"))

        def one(acc: Column, s: Column) -> Column:
            here = acc["at"] + s["gap"]
            span = F.struct(here.alias("start"), (here + s["hit"]).alias("end"))
            return start(here + s["hit"], F.when(s["holds"], F.array_append(acc["found"], span)).otherwise(acc["found"]))

        def piece(acc: Column, p: Column) -> Column:
            return _let(F.aggregate(p, start(acc["at"], none), one), lambda a: start(a["at"], F.array_append(acc["found"], a["found"])))

        return F.aggregate(pieces, start(F.lit(0), F.array().cast(f"array<array<{SPAN}>>")), piece, lambda a: F.flatten(a["found"]))

    found = _let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))
    return F.when(text.contains(rule.guard), found).otherwise(none) if rule.guard else found


def versions(history: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, blob, row) of every row of the history: its key, a short hash of its text, the blob and a row number; written once."""
    t = F.coalesce(F.col(text), F.lit(""))
    return staged(history.select(F.col(key).alias("id"), F.xxhash64(t).alias("mark"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("blob"), F.monotonically_increasing_id().alias("row")), "versions")


def unseen(held: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, mark, id, missing): each blob that lacks some of the rules in the ledger, the smallest key that holds it, and these rules."""
    wanted = F.array(*(F.lit(r.id) for r in rules))
    blobs = held.groupBy("blob", "mark").agg(F.min("id").alias("id"))
    if ledger is None:
        return blobs.withColumn("missing", wanted)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
    both = blobs.join(seen, "blob", "left").withColumn("missing", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
    return both.where(F.size("missing") > 0).drop("seen")


def scan(history: DataFrame, ledger: DataFrame | None = None, *, rules=RULES, key: str = "doc_id", text: str = "text", held: DataFrame | None = None) -> DataFrame:
    """The rows to append to the ledger (blob, scanned, findings): every blob with the rules that were missing for it."""
    held = versions(history, key=key, text=text) if held is None else held
    todo = unseen(held, ledger, rules).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "blob", "missing")
    t = F.coalesce(F.col(text), F.lit(""))
    texts = history.select(F.col(key).alias("id"), t.alias("t"), F.xxhash64(t).alias("mark"))
    one = texts.join(todo.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).where(F.unhex(F.sha2(F.col("t").cast("binary"), 256)) == F.col("blob"))

    def found(r: Rule) -> Column:
        named = F.transform(spans(F.col("t"), r), lambda s: F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(F.array_contains("missing", r.id), named).otherwise(F.array().cast(f"array<{FINDING}>"))

    rows = one.select("blob", F.col("missing").alias("scanned"), F.concat(*map(found, rules)).alias("findings"))
    return staged(rows.distinct(), "ledger")  # rows of one key and one text come in together


def append(rows: DataFrame, path: str) -> None:
    """Add scan()'s rows to the ledger at path."""
    rows.write.mode("append").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path; None if nothing stands there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(LEDGER).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def on_paths(history: DataFrame, ledger: DataFrame, *, rules=RULES, key: str = "doc_id", text: str = "text", held: DataFrame | None = None) -> DataFrame:
    """history with `blob` and `findings` of these rules' versions, sorted by place and then as the rules are listed.

    With held (versions() of the history), only its key comes back beside them, and texts are not read again.
    """
    names = [c for c in history.columns if c not in ("blob", "findings")] if held is None else [key]
    if held is None:
        content = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
        left = staged(history.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("kept"), content.alias("blob"), F.monotonically_increasing_id().alias("row")), "history")
    else:
        left = held.select(F.struct(F.col("id").alias(key)).alias("kept"), "blob", "row")
    order = {r.name: i for i, r in enumerate(rules)}
    ids = F.array(*(F.lit(r.id) for r in rules))
    now = ledger.select("blob", F.filter("findings", lambda f: F.array_contains(ids, F.concat_ws("/", f["rule"], f["version"]))).alias("own")).where(F.size("own") > 0)
    place = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*map(F.lit, order.values())))
    # Runs that saw different rules hold a row each: what they found is put together once a blob.
    now = now.select("blob", F.transform("own", lambda f: F.struct(f["start"].alias("start"), F.element_at(place, f["rule"]).alias("order"), f["end"].alias("end"), f["version"].alias("version"), f["rule"].alias("rule"))).alias("own"))
    now = now.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("own"))
    now = now.select("blob", F.transform("own", lambda f: F.struct(f["rule"].alias("rule"), f["version"].alias("version"), f["start"].alias("start"), f["end"].alias("end"))).alias("own"))
    hot = left.groupBy("blob").count().where(F.col("count") * HOT_SHARE > left.count()).select("blob", F.lit(True).alias("_hot"))  # fewer than HOT_SHARE blobs, by arithmetic
    hot = F.broadcast(staged(hot, "hot"))
    salted = left.join(hot, "blob", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.hash("row"), F.lit(SALTS))).otherwise(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    now = now.join(hot, "blob", "left").select("blob", "own", F.explode(copies).alias("_salt"))
    out = salted.alias("l").join(now.alias("r"), (F.col("l.blob") == F.col("r.blob")) & (F.col("l._salt") == F.col("r._salt")), "left")
    return out.select(*(F.col(f"l.kept.`{c}`") for c in names), F.col("l.blob"), F.coalesce("r.own", F.array().cast(f"array<{FINDING}>")).alias("findings"))


def joined(findings: Column) -> Column:
    """rule:start:end of each, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ",")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = versions(docs)
    rows = on_paths(docs, scan(docs, held=held), held=held)
    of = lambda name: F.filter("findings", lambda f: f["rule"] == name)
    base = F.filter("findings", lambda f: f["rule"].isin([r.name for r in BASE]))
    return rows.select(
        "doc_id", *(F.size(of(r.name)).cast("long").alias(f"n_{r.name}") for r in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    steps = ["WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    each = []
    for i, rule in enumerate(RULES):
        p = quote(rule.pattern)
        steps.append(f"h{i} AS (SELECT r, regexp_extract_all(text, {p}) AS hits, string_split_regex(text, {p}) AS gaps FROM t WHERE regexp_matches(text, {p}))")
        steps.append(f"s{i} AS (SELECT r, j, hits[j] AS hit, list_sum(list_transform(gaps[:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:j - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM h{i}))")
        held = f" WHERE length(regexp_extract(hit, {p}, 2)) >= {rule.tail}" if rule.tail else ""
        each.append(f"SELECT r, {i} AS o, '{rule.name}' AS kind, a::BIGINT AS a, (a + length(hit))::BIGINT AS z FROM s{i}{held}")
    steps.append("f AS (" + " UNION ALL ".join(each) + ")")
    count = ", ".join(f"count(*) FILTER (kind = '{r.name}')::BIGINT AS n_{r.name}" for r in BASE)
    text = "kind || ':' || a || ':' || z, ',' ORDER BY a, o"
    return ",\n".join(steps) + f"""
SELECT doc_id, {count}, sha256(coalesce(string_agg({text}) FILTER (o < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({text}), '') AS spans
FROM t LEFT JOIN f USING (r) GROUP BY r, doc_id
"""


ORACLE = _oracle()
