"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

The benchmark's windows go out in slices of about ``max_windows`` (a broadcast of known size); a benchmark beyond one
slice takes more passes over the documents, which carry their hits along in their own rows. A document window whose hash
is in the set is verified word by word before it counts.

Defined results: null and empty texts have no words and no hit; null, empty and wordless items have no window and hit
nothing; items that share a text or an id all count (ids once); a null item_id or doc_id stays as it is, nulls in item
lists are left out; repeated document rows give repeated result rows, rows with one id and different texts are judged
apart; where windows tie or overlap all of them count; a very long text is scanned whole, alone, in memory in proportion
to its length; an empty table on either side gives no hits or no rows; columns beyond the named ones are ignored by
hits() and kept by clean(), whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankeval.llm.common import ALNUM, Words, chunks, mapped, pieces, raw_texts, staged

WINDOW = 10
MAX_WINDOWS = 1_000_000

Windows = dict[int, tuple[np.ndarray, list[list[tuple[tuple[bytes, ...], object]]]]]


def item_windows(items: list[tuple[object, str | None]], window: int) -> list[tuple[int, int, tuple[bytes, ...], object]]:
    """(length, hash, words, item) of every window of the items; an item of fewer words is one window."""
    out = []
    for item, text in items:
        w = Words([(text or "").encode()], ALNUM)
        k = min(window, len(w.hash))
        if not k:
            continue
        words = w.text(0, len(w.hash))
        at, h = w.windows(k)
        out += [(k, x, tuple(words[a : a + k]), item) for a, x in zip(at.tolist(), h.tolist(), strict=True)]
    return out


def indexed(rows: list[tuple[int, int, tuple[bytes, ...], object]]) -> Windows:
    """For each window length: the sorted hashes, and beside each the windows and items it stands for."""
    by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for k, h, words, item in dict.fromkeys(rows):
        by[k][h].append((words, item))
    return {k: (np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for k, x in by.items()}


def scan(texts: list[bytes], windows: Windows) -> Iterator[tuple[int, list[int], list]]:
    """(number of words, hit word positions, items found) of each text."""
    for a, b in chunks(texts):
        w = Words(texts[a:b], ALNUM)
        spans: dict[int, list[np.ndarray]] = defaultdict(list)
        found: dict[int, set] = defaultdict(set)
        for k, (hashes, held) in windows.items():
            at, h = w.windows(k)
            where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero(hashes[where] == h).tolist():
                p, doc = int(at[i]), int(w.doc[at[i]])
                words = tuple(w.text(p, p + k))
                if same := [item for x, item in held[where[i]] if x == words]:
                    spans[doc].append(np.arange(p, p + k) - w.first[doc])
                    found[doc].update(same)
        for i in range(b - a):
            hit = np.unique(np.concatenate(spans[i])).tolist() if i in spans else []
            yield int(w.first[i + 1] - w.first[i]), hit, [x for x in found.get(i, ()) if x is not None]


def _slices(benchmark: DataFrame, item: str, text: str, window: int, max_windows: int) -> Iterator[list]:
    """The benchmark's windows in lists of about max_windows, made as they are asked for; at least one list."""
    held, some = [], False
    for row in benchmark.select(item, text).toLocalIterator():
        held += item_windows([tuple(row)], window)
        if len(held) >= max_windows:
            yield held
            held, some = [], True
    if held or not some:
        yield held


def _free(names: list[str], name: str) -> str:
    """name, or the like of it that no column has."""
    while name.lower() in (n.lower() for n in names):
        name = f"_{name}"
    return name


def _scanned(docs: DataFrame, text: str, slices: Iterator[list], finish: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema) -> DataFrame:
    """finish(batch, rows) of every batch of docs, rows being (number of words, hit words, items) of each text.

    Every slice's pass scans the texts as they came. What earlier slices hit travels in the row itself, so any number of
    slices finds the same, whichever rows look alike. A pass is written before the next slice goes out: the driver holds
    two slices at most, a worker one.
    """
    at, columns = docs.columns.index(text), len(docs.columns)
    more = T.StructType([*docs.schema.fields, T.StructField(_free(docs.columns, "_hit"), T.ArrayType(T.IntegerType())), T.StructField(_free(docs.columns, "_items"), T.ArrayType(T.StringType()))])
    rows, first = next(slices), True
    while True:
        after = next(slices, None)
        sent = docs.sparkSession.sparkContext.broadcast(indexed(rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first, last=after is None) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                found = [(n, hit, [str(x) for x in items]) for n, hit, items in scan(raw_texts(batch.column(at)), sent.value)]
                if not first:
                    old = zip(*(batch.column(columns + i).to_pylist() for i in range(2)), strict=True)
                    found = [(n, sorted({*hit, *h}), sorted({*items, *x})) for (n, hit, items), (h, x) in zip(found, old, strict=True)]
                    batch = batch.select(list(range(columns)))
                if last:
                    yield finish(batch, found)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.string()))], more.fieldNames())

        docs = mapped(docs, run, schema if after is None else more)
        if after is None:
            return docs
        docs, rows, first = staged(docs, "hits"), after, False


def hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """key, n_words, hit (sorted positions of the words in any window), items (ids as strings, sorted)."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        made = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([sorted(set(f[2])) for f in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *made], ["key", "n_words", "hit", "items"])

    kind = docs.schema[0].dataType.simpleString()
    return _scanned(docs, "text", _slices(benchmark, item, text, window, max_windows), finish, f"key {kind}, n_words bigint, hit array<int>, items array<string>").withColumnRenamed("key", key)


def without(text: str, hit: set[int]) -> str:
    """text less its hit words and the characters between neighbouring ones."""
    w = Words([raw := text.encode()], ALNUM)
    out, last = [], 0
    starts, ends = w.starts.tolist(), w.ends.tolist()
    for i in sorted(hit):
        if i - 1 in hit:
            last = ends[i]
            continue
        out.append(raw[last : starts[i]])
        last = ends[i]
    return b"".join([*out, raw[last:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.5, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with the hit spans cut out of their texts; documents of which more than max_share of the words are hit go.

    Texts stay in their rows, so nothing is shuffled; shares are judged and texts are cut once, by the hits of all slices.
    """
    at = docs.columns.index(text)

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        if any(hit for _, hit, _ in found):
            new = [t if not hit else without(t, set(hit)) for t, (_, hit, _) in zip(batch.column(at).to_pylist(), found, strict=True)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))
        return batch.filter(pa.array([len(hit) <= max_share * n for n, hit, _ in found], pa.bool_()))

    return _scanned(docs, text, _slices(benchmark, item, text, window, max_windows), finish, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns of hits()."""
    from rankeval.llm.common import table

    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


__all__ = ["hits", "clean", "op4"]
