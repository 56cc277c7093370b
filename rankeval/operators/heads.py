"""The heads of many ranked lists at once, within a task: what cannot be among the first k does not leave it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of results that a task holds for a block of queries.
HELD = 400_000


class Best:
    """The k best documents of each of some queries among the chunks that were added, by their best chunk, the first of equals.

    Of rows that are no chunks (not merged) each counts by itself. Null ids come first, as in Spark.
    """

    def __init__(self, k: int, queries: int, merged: bool = True):
        self.k, self.merged, self.bar, self.held, self.size = k, merged, np.full(queries, -np.inf), [], 0

    def add(self, docs: pa.Array, pos: pa.Array, scores: np.ndarray) -> None:
        order = np.asarray(pc.sort_indices(pa.table([docs, pos], ["d", "p"]), [("d", "ascending"), ("p", "ascending")], null_placement="at_start"))
        docs, pos, scores = docs.take(pa.array(order)), pos.take(pa.array(order)), scores[order]
        n = len(docs)
        first, best = np.arange(n), scores
        if self.merged:
            new = ~pc.fill_null(pc.equal(docs.slice(1), docs.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], 1 + np.flatnonzero(new)]).astype(np.int64)
            best = np.maximum.reduceat(scores, first, axis=0)
        keep = best >= self.bar
        if len(best) > self.k:
            kth = np.partition(best, len(best) - self.k, axis=0)[len(best) - self.k]
            equal = best == kth
            keep &= (best > kth) | equal & (np.cumsum(equal, 0) <= self.k - (best > kth).sum(0))
        d, q = np.nonzero(keep)
        if not len(d):
            return
        at = first[d]
        if len(first) < n:  # a document's first chunk that has its score
            ends = np.append(first[1:], n)
            at = np.array([i + int(scores[i:e, c].argmax()) for i, e, c in zip(first[d].tolist(), ends[d].tolist(), q.tolist(), strict=True)])
        self.held.append(pa.table([pa.array(q), docs.take(pa.array(at)), pa.array(best[d, q]), pos.take(pa.array(at))], ["q", "doc", "score", "pos"]))
        self.size += len(d)
        if self.size > 2 * HELD:
            self._cut()

    def _cut(self) -> None:
        t = pa.concat_tables(self.held)
        t = t.take(pc.sort_indices(t, [("q", "ascending"), ("score", "descending"), ("doc", "ascending"), ("pos", "ascending")], null_placement="at_start"))
        q, once = t.column("q").to_numpy(), np.arange(t.num_rows)
        if self.merged:
            doc = t.column("doc").combine_chunks().dictionary_encode(null_encoding="encode")
            _, once = np.unique(q * (len(doc.dictionary) + 1) + np.asarray(doc.indices), return_index=True)
            once.sort()
        place = np.arange(len(once)) - np.searchsorted(q[once], q[once])
        once, place = once[place < self.k], place[place < self.k]
        t = t.take(pa.array(once)).combine_chunks()
        last = place == self.k - 1
        self.bar[t.column("q").to_numpy()[last]] = t.column("score").to_numpy()[last]
        self.held, self.size = [t], t.num_rows

    def tables(self) -> list[pa.Table]:
        if self.held:
            self._cut()
        return self.held
