"""Removal of long repeated strings by difference-cover, blockwise suffix sorting.

A string of ``length`` bytes that stands at two places has the same anchor at both: the start of the least of its k-gram
hashes, leftmost of equals (winnowing). All strings whose anchor has one k-gram make a bucket of suffixes; only buckets
with two places or more are looked at again, so unrepeated text is never sorted.

- Places with the same neighbourhood (every byte of every string around the anchor) are counted by its digest with partial
  sums. A neighbourhood that is there twice repeats as a whole.
- Neighbourhoods of one bucket that differ are sorted in blocks of bounded size. A block's cover sample (positions whose
  residue lies in a difference cover) is ranked once, by doubling. The suffixes are then sorted one bucket at a time (those
  that begin o bytes before their anchor), by the few bytes before the next sample position and, for the long tie behind
  them, by that sample's ranks. Anchors are laid out on multiples of the cover's period, so one step to the sample serves a
  whole bucket.
- A bucket with more than ``hot_places`` different neighbourhoods is dealt out by the digest of each whole string instead.

Defined results: null is the empty text; texts shorter than ``length`` lose nothing; equal rows are two places each, so
they repeat; overlapping repeats within a text count; of equal strings none comes first, all of them go; a very long text
is read whole, alone, in memory in proportion to its length, and its repeats are cut like others; null ids are kept; an
empty table gives an empty table; further columns are ignored by repeats() and kept by without_repeats(), whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import CHUNK_BYTES, chunks, mapped, pieces, powers, prefix_hash, raw_texts, staged, table, unstage

LENGTH = 400
GRAM = 100
PERIOD = 64
BLOCK_BYTES = 6 << 20
HOT_PLACES = 20_000


def difference_cover(v: int) -> np.ndarray:
    """Residues such that any two numbers reach them by a common step: 0..r-1 and the multiples of r, r = ceil(sqrt(v))."""
    r = int(np.ceil(np.sqrt(v)))
    return np.unique(np.concatenate([np.arange(r), np.arange(0, v, r)]))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, from running minima within blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    forth = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: places of anchors, hashes of their k-grams, and the first and last start of the strings they anchor."""
    none = np.zeros(0, np.int64)
    for a, b in chunks(texts):
        buf = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])]).astype(np.int64)
        if len(buf) < length:
            yield from ((none, none.view(np.uint64), none, none) for _ in range(a, b))
            continue
        sums = prefix_hash(buf)
        grams = (sums[gram:] - sums[:-gram]) * powers(len(sums))[1][: len(sums) - gram]
        rank = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        least = (_sliding_least(rank, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = least[s : max(s, e - length + 1)]
            if not len(own):
                yield none, none.view(np.uint64), none, none
                continue
            first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            last = np.concatenate([first[1:] - 1, [len(own) - 1]])
            yield own[first] - s, grams[own[first]], first, last


def _described(docs: DataFrame, length: int, gram: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "r1", "r2", "n_bytes", "sha", "pos", "h", "lo", "hi", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = raw_texts(batch.column(3))
            for a, b in chunks(texts, 4 * CHUNK_BYTES):
                found = list(anchors(texts[a:b], length, gram))
                digests = [np.frombuffer(b"".join(hashlib.blake2b(t[x : y + length], digest_size=8).digest() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64) for t, (_, _, lo, hi) in zip(texts[a:b], found, strict=True)]
                edges = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]), pa.int32())
                flat = lambda parts, kind: pa.ListArray.from_arrays(edges, pa.array(np.concatenate(parts), kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(a, b - a) for i in range(3)), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts[a:b]]),
                        flat([f[0] for f in found], pa.int32()), flat([f[1].view(np.int64) for f in found], pa.int64()), flat([f[2] for f in found], pa.int32()), flat([f[3] for f in found], pa.int32()), flat(digests, pa.int64()),
                    ],
                    names,
                )

    return mapped(docs, run, f"id {kind}, r1 bigint, r2 bigint, n_bytes bigint, sha string, pos array<int>, h array<bigint>, lo array<int>, hi array<int>, d array<bigint>")


class Block:
    """Neighbourhoods of anchors, laid out one after the other with every anchor on a multiple of PERIOD."""

    def __init__(self, length: int):
        self.length, self.parts, self.size, self.at = length, [], 0, []

    def add(self, text: bytes, before: int) -> None:
        """text has its anchor at before."""
        pad = -(self.size + before) % PERIOD
        self.parts += [bytes(pad), text]
        self.at.append(self.size + pad + before)
        self.size += pad + len(text)

    def repeated(self, least_o: np.ndarray, most_o: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(places, o) for every o with places whose string that begins o before the anchor is there again."""
        buf = np.frombuffer(b"".join([*self.parts, bytes(self.length + 2 * PERIOD)]), np.uint8)
        words = np.ndarray((len(buf) - 7,), ">u8", buf.tobytes(), strides=(1,))
        at, cover = np.array(self.at), difference_cover(PERIOD)
        is_in = np.zeros(PERIOD, bool)
        is_in[cover] = True
        sample = np.flatnonzero(is_in[np.arange(self.size) % PERIOD])
        # Ranks of the sample by its first PERIOD bytes, then by doubling; a sample's place plus PERIOD is one again.
        ranks = self._ranked([words[np.minimum(sample + 8 * i, len(words) - 1)].astype(np.uint64) for i in range(PERIOD // 8)])
        by_place = np.zeros(len(buf) + self.length, np.int64)
        depth, held = PERIOD, {}
        while depth * 2 <= self.length:
            by_place[sample] = ranks + 1
            held[depth] = by_place.copy() if depth * 4 > self.length else None
            ranks = self._ranked([by_place[sample], by_place[sample + depth]])
            depth *= 2
        by_place[sample] = ranks + 1
        held[depth] = by_place
        depths = [d for d in sorted(held, reverse=True) if held[d] is not None]
        step = np.array([next(d for d in range(PERIOD) if is_in[(d - o) % PERIOD]) for o in range(PERIOD)])
        for o in range(int(least_o.min()), int(most_o.max()) + 1):
            own = np.flatnonzero((least_o <= o) & (o <= most_o))
            if len(own) < 2:
                continue
            start, delta = at[own] - o, int(step[o % PERIOD])
            keys, done = [], delta
            if delta:
                keys.append(words[start] >> np.uint64(64 - 8 * delta))
            for d in depths:
                while self.length - done >= d:
                    keys.append(held[d][start + done])
                    done += d
            while done < self.length:  # the last bytes; two words may overlap
                keys.append(words[start + min(done, self.length - 8)])
                done += 8
            same = self._ranked([k.astype(np.uint64) for k in keys])
            again = own[np.bincount(same)[same] > 1]
            if len(again):
                yield again, o

    @staticmethod
    def _ranked(keys: list[np.ndarray]) -> np.ndarray:
        """Dense ranks by the keys, the first one counting most; equals share one."""
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out


def _neighbourhoods(places: DataFrame, length: int) -> DataFrame:
    """places: (r1, r2, list of h, pos, lo, hi, hot; text), to a row for each neighbourhood, or for each string if hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "r1", "r2", "pos", "lo", "hi", "part", "string"]
        for batch in pieces(batches):
            out: list[list] = [[] for _ in names]
            size = 0
            for r1, r2, wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), raw_texts(batch.column(3)), strict=True):
                for w in wanted:
                    whole = [(w["lo"], w["hi"], text[w["lo"] : w["hi"] + length], None)]
                    if w["hot"]:
                        whole = [(s, s, None, hashlib.blake2b(text[s : s + length], digest_size=16).digest()) for s in range(w["lo"], w["hi"] + 1)]
                    for lo, hi, part, string in whole:
                        for x, y in zip(out, (w["h"], r1, r2, w["pos"], lo, hi, part, string), strict=True):
                            x.append(y)
                        size += len(part or b"") + 64
                if size > 4 * CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)
                    out, size = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2
    return mapped(places, run, "h bigint, r1 bigint, r2 bigint, pos int, lo int, hi int, part binary, string binary")


def _sorted_repeats(parts: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(r1, r2, lo, hi): starts of repeated strings, from neighbourhoods whose buckets come together."""

    def solved(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        block = Block(length)
        for _, _, _, pos, lo, _, part in rows:
            block.add(part, pos - lo)
        pos, lo, hi = (np.array([r[i] for r in rows]) for i in (3, 4, 5))
        who, starts = [], []
        for places, o in block.repeated(pos - hi, pos - lo):
            who.append(places)
            starts.append(pos[places] - o)
        if who:
            who, starts = np.concatenate(who), np.concatenate(starts)
            order = np.lexsort((starts, who))
            who, starts = who[order], starts[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(starts) != 1)]))
            last = np.concatenate([first[1:] - 1, [len(who) - 1]])
            of = who[first].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in of], pa.int64()), pa.array([rows[i][2] for i in of], pa.int64()), pa.array(starts[first], pa.int32()), pa.array(starts[last], pa.int32())], ["r1", "r2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size > block_bytes and row[0] != rows[-1][0]:  # a bucket stays in one block
                    yield from solved(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6]) + PERIOD
        if rows:
            yield from solved(rows)

    return mapped(parts, run, "r1 bigint, r2 bigint, lo int, hi int")


def _cut(text: bytes, starts: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(text less the strings that start in the ranges, bytes removed, runs removed)."""
    gone = np.zeros(len(text) + 1, np.int64)
    lo, hi = np.array(starts).T
    np.add.at(gone, lo, 1)
    np.add.at(gone, hi + length, -1)
    gone = np.cumsum(gone[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum())


def repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot_places: int = HOT_PLACES) -> tuple[DataFrame, DataFrame]:
    """docs has id, r1, r2, text. A row for each document (id, r1, r2, n_bytes, sha), and (r1, r2, starts) of those with repeats."""
    described = staged(_described(docs, length, gram), "anchors")
    each = described.select("r1", "r2", F.explode(F.arrays_zip("h", "d", "pos", "lo", "hi")).alias("a")).select("r1", "r2", "a.h", "a.d", "a.pos", "a.lo", "a.hi")
    kinds = staged(each.groupBy("h", "d").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("r1", "r2", "pos", "lo", "hi")).alias("one")), "kinds")
    buckets = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    whole = each.join(kinds.where("places > 1").select("h", "d"), ["h", "d"]).select("r1", "r2", "lo", "hi")
    wanted = kinds.join(buckets, "h").select("one.r1", "one.r2", F.struct("h", "one.pos", "one.lo", "one.hi", (F.col("kinds") > hot_places).alias("hot")).alias("w"))
    wanted = wanted.groupBy("r1", "r2").agg(F.collect_list("w").alias("wanted"))
    texts = docs.select("r1", "r2", "text").join(wanted, ["r1", "r2"]).select("r1", "r2", "wanted", "text")
    parts = staged(_neighbourhoods(texts, length), "parts")
    sorts = parts.where("part is not null").select("h", "r1", "r2", "pos", "lo", "hi", "part").repartition("h").sortWithinPartitions("h", "r1", "r2", "pos")
    strings = parts.where("part is null")
    again = strings.groupBy("h", "string").agg(F.min(F.struct("r1", "r2", "lo")).alias("x"), F.max(F.struct("r1", "r2", "lo")).alias("y")).where("x != y").select("h", "string")
    found = whole.unionByName(_sorted_repeats(sorts, length, block_bytes)).unionByName(strings.join(again, ["h", "string"]).select("r1", "r2", "lo", "hi"))
    starts = staged(found.groupBy("r1", "r2").agg(F.collect_set(F.struct("lo", "hi")).alias("starts")), "starts")
    unstage(parts)
    unstage(kinds)
    return described.select("id", "r1", "r2", "n_bytes", "sha"), starts


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("r1"), F.xxhash64(F.lit("second"), key, text).alias("r2"), F.col(text).alias("text"))


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, one row for each row of docs."""
    docs = _keyed(docs, key, text)
    rows, starts = repeats(docs, length=length, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            cut = [_cut(t, [(s["lo"], s["hi"]) for s in x], length) for x, t in zip(batch.column(2).to_pylist(), raw_texts(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut])], ["r1", "r2", "n_removed", "n_spans", "kept"])

    cut = mapped(docs.select("r1", "r2", "text").join(starts, ["r1", "r2"]).select("r1", "r2", "starts", "text"), run, "r1 bigint, r2 bigint, n_removed bigint, n_spans bigint, kept string")
    cut = staged(cut, "cut").groupBy("r1", "r2").agg(F.min("n_removed").alias("n_removed"), F.min("n_spans").alias("n_spans"), F.min("kept").alias("kept"))  # repeated rows are one
    zero = F.lit(0).cast("long")
    return rows.join(cut, ["r1", "r2"], "left").select(F.col("id").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """docs with the repeated strings gone from text; a character that loses some of its bytes becomes U+FFFD."""
    _, starts = repeats(_keyed(docs, key, text), length=length, **how)
    # The caller's columns travel in one struct, so their names meet none of these.
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(key, text).alias("r1"), F.xxhash64(F.lit("second"), key, text).alias("r2"), F.col(text).alias("text"))
    both = keyed.join(starts, ["r1", "r2"], "left").select("row", "text", "starts")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            new = [t if x is None else _cut(t.encode(), [(s["lo"], s["hi"]) for s in x], length)[0].decode(errors="replace") for x, t in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = batch.column(0).flatten()
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(both, run, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
