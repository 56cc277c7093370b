"""Spelling variant grouping: words one error apart, each group led by its frequent spellings.

Two words one error apart agree in the first half, or in the last, of the shorter one. So every word is dealt out twice a
length: under its first half and under its last one. The words under one half are read into a minimal acyclic automaton,
forward under a first half and backward under a last one, whose states number the words that pass them; a word follows its
own path there, leaves it by one error and completes exactly, which ends at the number of a near word. A pair that both
directions meet counts in the one that holds the place where the words part. What travels on is a row a word and half:
the number of near words and the most frequent one.

A half that more than `limit` words share is split: the window in which they may differ is halved, each word is dealt out
under both, and so on, so no task holds more words under one key. Sizes are told by a fixed number of hashed counters;
a word that is split without need is found all the same.

Defined results: null and empty texts have no words; a null id is the empty string in front of the colon; equal rows count
as often as they occur; of near words that are as frequent the first in code-point order leads; very long texts are
exploded like others, very long words are split like others; an empty table gives an empty table; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import mapped, staged, table

RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: One occurrence in so many loses a letter, by the checksum of its document and itself.
SLIP = 199
#: Words that may share a key, and hashed counters that tell how many do.
LIMIT, SLOTS = 20_000, 1 << 18
#: Rows of a batch that the kernel returns.
ROWS = 8192


def runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, run) of every run of at least min_chars letters, A-Z lower-cased; id as text, null as the empty one."""
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    return each.where(F.length("run") >= min_chars).select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))


def slipped(id_: Column, run: Column, one_in: int = SLIP) -> Column:
    """run, without one code point where the checksum of `id:run` says so."""
    h = F.crc32(F.encode(F.concat(id_, F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, *, word: str = "word", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    rows = words.where(F.length(word) >= min_chars).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of some words, given sorted; a state is [final, {letter: (state, words before)}, words]."""

    def __init__(self, words: list[str]):
        self.known: dict = {}
        path, last = [[False, {}, 0]], ""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            self._close(path, last, same)
            for _ in w[same:]:
                path.append([False, {}, 0])
            path[-1][0] = True
            last = w
        self._close(path, last, 0)
        self.root = self._numbered(path[0])

    def _close(self, path: list, last: str, keep: int) -> None:
        """States beyond the first keep letters of last get no more words: equal ones become one."""
        for i in range(len(path) - 1, keep, -1):
            path[i - 1][1][last[i - 1]] = self._numbered(path.pop())

    def _numbered(self, state: list) -> list:
        same = self.known.get(name := (state[0], tuple((c, id(s)) for c, s in state[1].items())))
        if same:
            return same
        n = int(state[0])
        for c, s in state[1].items():
            state[1][c] = (s, n)
            n += s[2]
        state[2] = n
        self.known[name] = state
        return state

    @staticmethod
    def _exact(state: list, rest: str, number: int) -> int:
        for c in rest:
            step = state[1].get(c)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if state[0] else -1

    def near(self, word: str) -> list[int]:
        """The numbers of the words that have one letter more or one other letter, each once."""
        out, state, number = [], self.root, 0
        for i in range(len(word) + 1):
            own, rest, after = word[i : i + 1], word[i:], word[i + 1 :]
            for c, (to, before) in state[1].items():
                if c != own:  # the first place where both part, read in this direction
                    out.append(self._exact(to, rest, number + before))
                    if own:
                        out.append(self._exact(to, after, number + before))
            step = state[1].get(own) if own else None
            if step is None:
                break
            state, number = step[0], number + step[1]
        return [x for x in out if x >= 0]


def _group(m: int, lo: int, hi: int, exact: str, cores: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count and spelling of the most frequent) of the words that share all but their core."""
    size = hi - lo
    shorter = [len(c) == size for c in cores]
    if len(cores) < 2 or not any(shorter):
        return
    backward = lo == 0
    order = sorted(range(len(cores)), key=lambda i: cores[i][::-1]) if backward else sorted(range(len(cores)), key=cores.__getitem__)
    turned = (lambda c: c[::-1]) if backward else (lambda c: c)
    automaton = Automaton([turned(cores[i]) for i in order])
    words = [exact[:lo] + c + exact[lo:] for c in cores]
    near, best = [0] * len(cores), [(0, "")] * len(cores)

    def met(i: int, j: int) -> None:
        near[i] += 1
        if counts[j] > best[i][0] or (counts[j] == best[i][0] and words[j] < best[i][1]):
            best[i] = (counts[j], words[j])

    for i, core in enumerate(cores):
        if not shorter[i]:
            continue
        for number in automaton.near(turned(core)):
            j = order[number]
            if hi == m or cores[j][:size] != core:  # else they part behind this window
                met(i, j)
                if not shorter[j]:
                    met(j, i)
    for i, n in enumerate(near):
        if n:
            yield words[i], n, *best[i]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in a row, out of sorted rows (m, lo, hi, exact, core, n)."""
    names = ["word", "n_near", "best_n", "best"]
    out: list = []

    def groups() -> Iterator[tuple]:
        now, cores, counts = None, [], []
        for batch in batches:
            for m, lo, hi, exact, core, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (m, lo, hi, exact):
                    if now:
                        yield *now, cores, counts
                    now, cores, counts = (m, lo, hi, exact), [], []
                cores.append(core)
                counts.append(n)
        if now:
            yield *now, cores, counts

    for g in groups():
        out += _group(*g)
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)


def _entries(words: DataFrame, min_chars: int) -> DataFrame:
    """Each word under both halves of the shorter word's length: as the shorter one, and as the longer one."""
    size = F.length("word")

    def under(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi")) for lo, hi in ((half, m), (F.lit(0), half))]

    every = F.when(size > min_chars, F.array(*under(size), *under(size - 1))).otherwise(F.array(*under(size)))
    w = words.select("word", "n", F.explode(every).alias("w")).select("word", "n", "w.m", "w.lo", "w.hi")
    return w.select("m", "lo", "hi", *_cut(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")), "n")


def _cut(word: Column, m: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    end = F.length(word) - (m - hi)
    exact = F.concat(F.substring(word, F.lit(1), lo), F.substring(word, end + 1, m - hi))
    return exact.alias("exact"), F.substring(word, lo + 1, end - lo).alias("core")


def _halved(rows: DataFrame) -> DataFrame:
    """Rows under both halves of their window."""
    word = F.concat(F.expr("substring(exact, 1, lo)"), F.col("core"), F.expr("substring(exact, lo + 1)"))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi"))))
    w = rows.select("m", word.alias("word"), "n", both.alias("w")).select("m", "word", "n", "w.lo", "w.hi")
    return w.select("m", "lo", "hi", *_cut(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")), "n")


def _dealt(words: DataFrame, min_chars: int, limit: int) -> DataFrame:
    """The entries, with none more than limit under one key where their window can be halved."""
    key = ("m", "lo", "hi", "exact")
    slot = F.pmod(F.xxhash64(*key), F.lit(SLOTS))
    rows, done = staged(_entries(words, min_chars), "entries"), None
    while True:
        # At most SLOTS rows of a number each.
        hot = staged(rows.groupBy(slot.alias("slot")).count().where(F.col("count") > limit).select("slot"), "hot")
        told = rows.withColumn("slot", slot)
        split = told.join(F.broadcast(hot), "slot", "left_semi").where("hi - lo > 1").drop("slot")
        split = staged(_halved(split), "halved") if hot.head() else None
        if split is None or split.head() is None:
            return rows if done is None else done.unionByName(rows)
        whole = told.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "slot", "left").where("_hot is null or hi - lo <= 1").select(*rows.columns)
        done = whole if done is None else done.unionByName(whole)
        rows = split


def near_words(words: DataFrame, *, min_chars: int = MIN_CHARS, limit: int = LIMIT) -> DataFrame:
    """(word, n) with n_near, the number of near words, and best and best_n, the most frequent one; null without any.

    words: distinct and not null, of min_chars code points or more (min_chars: at least 2).
    """
    words = staged(words.select("word", "n"), "words")
    key = ["m", "lo", "hi", "exact"]
    found = mapped(_dealt(words, min_chars, limit).repartition(*key).sortWithinPartitions(*key), _near, "word string, n_near long, best_n long, best string")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: bigint, best: string>").alias("b"))
    met = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("b"))
    out = own.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("b").alias("b"))
    return out.select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def grouped(words: DataFrame, *, ratio: int = RATIO, min_chars: int = MIN_CHARS, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counted words.

    form: the most frequent near word, where it is ratio times as frequent; root: the last of the forms that follow from
    the word. Counts grow by ratio from form to form, so there are at most log(largest count) rounds; a word is the form of
    no more words than it has near spellings, so no key of these joins is hot.
    """
    led = F.col("best_n") >= ratio * F.col("n")
    rows = near_words(words, min_chars=min_chars, limit=limit)
    rows = staged(rows.select("word", "n", "n_near", F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")), "forms")
    to = rows.where("form is not null").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    going, ended = to.select(F.col("_from").alias("word"), F.col("_to").alias("root")), None
    while True:
        step = staged(going.join(to, going["root"] == to["_from"], "left").select("word", "root", "_to"), "roots")
        stop = step.where("_to is null").select("word", "root")
        ended = stop if ended is None else ended.unionByName(stop)
        going = step.where("_to is not null").select("word", F.col("_to").alias("root"))
        if going.head() is None:
            break
    out = rows.join(ended, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    each = runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped(counted(each.select(slipped(F.col("id"), F.col("run")).alias("word"))))


ORACLE = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
r AS (SELECT doc_id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM documents) WHERE length(run) >= {MIN_CHARS}),
c AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY doc_id, run),
h AS (SELECT run, k, xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
      lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) AS h FROM c, tab),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
d AS MATERIALIZED (SELECT DISTINCT word, n, i, word[:i] || word[i + 2:] AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b USING (i, cut) WHERE a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word),
g AS (SELECT word, count(DISTINCT other)::BIGINT AS n_near, min(struct_pack(less := -m, other := other)) AS b FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= {RATIO} * v.n THEN b.other END AS form, CASE WHEN -b.less >= {RATIO} * v.n THEN -b.less END AS form_n FROM v LEFT JOIN g USING (word)),
t AS (SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.at = f.word WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.at AS root FROM t JOIN f ON t.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN e USING (word)
"""
