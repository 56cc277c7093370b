"""Labelled texts for the trained operators: a bounded sample of rows that may be learnt from, spread over all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import NOT_SPACE, Words, chunks


def held_out(key: str = "doc_id") -> Column:
    """True for the rows from which nothing is learnt: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, key: str = "doc_id", text: str = "text") -> list[tuple[bytes, int]]:
    """At most per_class texts of each class (0 and 1), by a hash of the id.

    The bound is on the fitted classifier's sample alone; a document with more labels has the highest, null labels count
    as none. Only the chosen ids (at most 2 * per_class) are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.lit("sample"), key)
    chosen = known.where("y = 1").orderBy(order).limit(per_class).unionByName(known.where("y = 0").orderBy(order).limit(per_class))
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(F.encode(F.col(text), "UTF-8"), "y", key).collect()
    rows.sort(key=lambda r: (r[2], r[0] or b""))
    return [(bytes(r[0] or b""), r[1]) for r in rows]


def groups(texts: list[bytes]) -> np.ndarray:
    """The group of each text, named by its first text: texts that share one of three hashes over their 3-word windows, and so on."""
    group = np.arange(len(texts))
    first: dict = {}

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for a, b in chunks(texts):
        w = Words(texts[a:b], NOT_SPACE)
        at, h = w.windows(3)
        cut = w.doc[at].searchsorted(range(b - a + 1))
        for i in range(b - a):
            own = h[cut[i] : cut[i + 1]]
            marks = [(j, int(m)) for j, m in enumerate((own.min(), own.max(), (own * h.dtype.type(0xD1B54A32D192ED03)).min()))] if len(own) else [(3, texts[a + i])]
            for m in marks:
                x, y = sorted((root(a + i), root(first.setdefault(m, a + i))))
                group[y] = x
    return np.array([root(i) for i in range(len(texts))], np.int64)


def shares(texts: list[bytes]) -> np.ndarray:
    """What each text counts: one, shared by the texts of its group, so that copies are no evidence of their own."""
    group = groups(texts)
    return 1 / np.bincount(group, minlength=len(texts))[group]


def distinct(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """rows less those that share a minimum over their 3-word windows with an earlier one."""
    seen: set = set()
    out = []
    texts = [t for t, _ in rows]
    for a, b in chunks(texts):
        w = Words(texts[a:b], NOT_SPACE)
        at, h = w.windows(3)
        cut = w.doc[at].searchsorted(range(b - a + 1))
        for i in range(b - a):
            own = h[cut[i] : cut[i + 1]]
            marks = [(j, int(m)) for j, m in enumerate((own.min(), own.max(), (own * h.dtype.type(0xD1B54A32D192ED03)).min()))] if len(own) else [(3, texts[a + i])]
            if not any(m in seen for m in marks):
                out.append(rows[a + i])
            seen.update(marks)
    return out
