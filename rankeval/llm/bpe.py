"""Byte-level BPE by corpus-level merge replay.

The words of a batch (matches of the pre-tokenizer's pattern) that no earlier batch of the worker brought are replayed
together: an inverted index from token pair to the places where it stands takes every merge in rank order, and a merge
touches only the neighbours of its places. Texts are then rows of word ids.

Defined results: null is the empty text, which has no ids; every row is encoded by itself, so ties, repeated rows and
empty tables need nothing special; a very long text is encoded whole, alone, in memory in proportion to its length;
further columns are left out but for those in keep.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import CHUNK_BYTES, chunks, mapped, pieces

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Words that a worker keeps between batches; beyond it the held words are let go and replayed when they come again.
HELD_WORDS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Ranks and pattern of one vocabulary, with the ids of the words met so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        order = np.argsort(left << 32 | right)
        self.pair, self.made = (left << 32 | right)[order], made[order]
        top = max(ranks.values()) + 1
        #: Tokens that can merge on into a token of a lower rank; their places in a word are taken one by one.
        self.risky = np.zeros(top, bool)
        self.risky[np.concatenate([left[made < left], right[made < right]])] = True
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * top
        for t, r in ranks.items():
            tokens[r] = t
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.word_at = np.zeros(1, np.int64)
        self.word_ids = np.zeros(0, np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair of ids merges into, -1 if nothing."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[at] == want, self.made[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids): every merge in rank order over all words, leftmost place of a word first."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate([[0], np.cumsum(size)])
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        n = len(ids)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[start[:-1][size > 0]] = -1
        after[start[1:][size > 0] - 1] = -1
        makes = np.full(n, -1)  # by place: what the pair that begins there merges into
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        open_ = np.flatnonzero((after >= 0) & (whole[word] < 0))  # a word that is a token is that token
        makes[open_] = self.merges(ids[open_], ids[after[open_]])
        places: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def index(at: np.ndarray) -> None:
            """Enter places under what they make now."""
            at = at[makes[at] >= 0]
            at = at[np.argsort(makes[at], kind="stable")]
            edge = np.flatnonzero(np.diff(makes[at])) + 1
            for part in np.split(at, edge) if len(edge) else [at] if len(at) else []:
                m = int(makes[part[0]])
                if m not in places:
                    places[m] = []
                    heapq.heappush(due, m)
                places[m].append(part)

        index(open_)
        while due:
            m = heapq.heappop(due)
            parts = places.pop(m)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[makes[at] == m]  # the others were overtaken by other merges
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1:
                free = np.concatenate([[True], right[:-1] != at[1:]])
                if not free.all():  # of places that overlap, the leftmost, then the next free one
                    run = np.maximum.accumulate(np.where(free, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
                    right = after[at]
                if self.risky[m]:
                    first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                    if not first.all():
                        places[m] = [at[~first]]
                        heapq.heappush(due, m)
                        at, right = at[first], right[first]
            far = after[right]
            ids[at], ids[right], makes[right] = m, -1, -1
            after[at] = far
            some = far >= 0
            before[far[some]] = at[some]
            makes[at] = -1
            makes[at[some]] = self.merges(ids[at[some]], ids[far[some]])
            near = before[at]
            near = near[near >= 0]
            makes[near] = self.merges(ids[near], ids[after[near]])
            index(np.unique(np.concatenate([at, near])))
        ids[start[:-1][whole >= 0]] = whole[whole >= 0]
        kept = (ids >= 0) & ((whole[word] < 0) | (np.arange(n) == start[word]))
        return np.bincount(word[kept], minlength=len(words)), ids[kept]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        if len(self.number) > HELD_WORDS:
            self._forget()
        number, split = self.number, []
        had = len(number)
        for t in texts:
            words = self.pattern.findall(t)
            for w in set(words).difference(number):
                number[w] = len(number)
            split.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        if len(number) > had:
            sizes, ids = self.replay([w.encode() for w in islice(number, had, None)])
            self.word_at = np.concatenate([self.word_at, self.word_at[-1] + np.cumsum(sizes)])
            self.word_ids = np.concatenate([self.word_ids, ids])
        words = np.concatenate(split) if split else np.zeros(0, np.int64)
        sizes = np.diff(self.word_at)[words]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        text_at = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
        return np.diff(ends[text_at]), self.word_ids[_ranges(self.word_at[words], sizes)]

    def decode(self, ids: np.ndarray) -> bytes:
        at = self.token_at[ids]
        return self.token_bytes[_ranges(at, self.token_at[ids + 1] - at)].tobytes()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


_KINDS = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_MAKE = {
    "n_tokens": lambda ids, back: len(ids),
    "token_ids": lambda ids, back: ids.astype(np.int32),
    "decoded": lambda ids, back: back,
    "ids_sha256": lambda ids, back: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
    "decoded_sha256": lambda ids, back: hashlib.sha256(back).hexdigest(),
}
_SQL = {"n_tokens": "bigint", "token_ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", returns: tuple[str, ...] = ("token_ids", "decoded"), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns in keep, then those asked for: n_tokens, token_ids, decoded (the bytes that the ids stand for) and the SHA-256 digests of either.

    A column in keep that has the name of one asked for gives way to it.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    keep = tuple(c for c in keep if c.lower() not in returns)
    docs = docs.select(F.col(text).alias("_text"), *keep)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[1:]] + [f"{r} {_SQL[r]}" for r in returns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = codec(path, pattern)
        for batch in pieces(batches):
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for a, b in chunks([t.encode() for t in texts], 4 * CHUNK_BYTES):
                sizes, every = it.encode_batch(texts[a:b])
                rows = [(ids, it.decode(ids)) for ids in np.split(every, np.cumsum(sizes)[:-1])]
                made = [pa.array([_MAKE[r](*row) for row in rows], _KINDS[r]) for r in returns]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)), *made], [*batch.schema.names[1:], *returns])

    return mapped(docs, run, kinds)


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode()'s outputs digested where they are made, so that they need not travel."""
    return encode(docs, returns=("n_tokens", "ids_sha256", "decoded_sha256"), **how)


def op6(spark, sf_dir: str) -> DataFrame:
    from rankeval.llm.common import table

    return digests(table(spark, sf_dir, "documents"))
