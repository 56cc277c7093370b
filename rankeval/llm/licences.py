"""Licence scans: a trained paragraph classifier, with DataFrame operations alone on the rows.

A paragraph is a block of lines between lines without a word, whatever its length, so a notice may be wrapped anywhere and
stand behind comment marks. In it a candidate is a run of words in which word pairs that the model knows follow each other
within ``gap`` words, with three words on either side. Of a candidate the set of known word 1-, 2- and 3-grams counts; the end of a sentence is a word.

Sparse logistic regression gives each licence family and the class `unknown` a probability; temperature and threshold are
fitted on rows held back and on licences of families that the model was never shown. Families are taken one after the
other: the likeliest against unknown is confirmed if the candidate holds half of one of its templates (a short template
whole; four fifths of one if other families stay likely too), or is an excerpt of one, and if what tells it from its
sisters agrees: versions and further conditions, as NEEDS and BARS say. Then that family's n-grams are taken away and the
likeliest of what is left is judged, against the whole candidate; the first family that is not confirmed ends it.

The model is fitted on the driver from the templates below and variants of them, so it is the same for every input. Every
template holds an anchor; texts and blocks without one are not looked into.

Defined results: null and empty texts have no lines; each row is judged by itself, so ties, repeated rows and empty
tables need nothing special; very long texts are judged whole; further columns are ignored. A family that declares
itself twice in one candidate counts once there, and of two sister families in one candidate (CC BY and CC BY-SA) the
narrower alone is found. A licence is declared without its version: not confirmed where versions are families.
"""

from __future__ import annotations

import functools
import json
import random
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankeval.llm.common import table


def _gnu(name: str, version: str, ids: tuple[str, ...], short: str) -> tuple[str, ...]:
    return (
        f"This work is licensed under the {name}, version {version}.",
        f"Licensed under the {name} v{version}.",
        f"Released under the {short} v{version} license.",
        f"Distributed under the terms of the {name}, version {version} or later. License: {short}{version}",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This program is free software; you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the Free Software Foundation.",
        *_spdx(*ids),
    )


def _spdx(*ids: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {i}" for i in ids)


def _commons(code: str, name: str) -> tuple[str, ...]:
    each = ((f"This work is licensed under a Creative Commons {name} {v} International License.", f"Licensed under {code} {v}.", f"License: {code} {v}", *_spdx(f"{code.replace(' ', '-')}-{v}")) for v in ("4.0", "3.0"))
    return tuple(t for ts in each for t in ts)


#: Notices by which the licences are commonly declared.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is licensed under the terms of the Apache 2.0 license.",
        "Released under the Apache-2.0 License.",
        *_spdx("Apache-2.0"),
    ),
    "mit": (
        "Released under the MIT License.",
        "MIT License",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        *_spdx("MIT"),
    ),
    "isc": (
        "Released under the ISC License.",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        *_spdx("ISC"),
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Distributed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        *_spdx("BSD-3-Clause", "BSD-2-Clause"),
    ),
    "gpl-2.0": _gnu("GNU General Public License", "2", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "GPL"),
    "gpl-3.0": _gnu("GNU General Public License", "3", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), "GPL"),
    "agpl-3.0": _gnu("GNU Affero General Public License", "3", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "AGPL"),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        *_gnu("GNU Lesser General Public License", "2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"), "LGPL"),
        *_gnu("GNU Lesser General Public License", "3", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), "LGPL"),
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
        *_spdx("MPL-2.0"),
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "Licensed under the Eclipse Public License v2.0.",
        *_spdx("EPL-2.0"),
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense license.",
        *_spdx("Unlicense"),
    ),
    "cc-by": _commons("CC BY", "Attribution"),
    "cc-by-sa": _commons("CC BY-SA", "Attribution-ShareAlike"),
    "cc-by-nc": _commons("CC BY-NC", "Attribution-NonCommercial"),
    "cc-by-nc-sa": _commons("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "cc-by-nd": _commons("CC BY-ND", "Attribution-NoDerivatives"),
    "cc0": (
        "To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide.",
        "Released under CC0 1.0 Universal public domain dedication.",
        *_spdx("CC0-1.0"),
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}

_SHARE = ("sa", "sharealike", "share alike")
_TRADE = ("nc", "noncommercial", "non commercial")
_DERIVE = ("nd", "noderivatives", "noderivs", "no derivatives")
_NOT_GPL = ("lesser", "library general", "lgpl", "affero", "agpl")
#: Of every group one n-gram must be there.
NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "apache-2.0": (("version 2", "apache 2", "license 2"),),
    "gpl-2.0": (("version 2", "gpl 2", "gplv2", "gpl v2", "gpl2", "license v2", "license 2"),),
    "gpl-3.0": (("version 3", "gpl 3", "gplv3", "gpl v3", "gpl3", "license v3", "license 3"),),
    "agpl-3.0": (("affero", "agpl", "agpl3", "agplv3"),),
    "lgpl": (("lesser", "lgpl", "lgpl2", "lgpl3", "library general"),),
    "mpl-2.0": (("v 2", "license 2", "version 2", "mpl 2", "v2"),),
    "epl-2.0": (("version 2", "license 2", "epl 2", "license v2"),),
    "cc-by-sa": (_SHARE,), "cc-by-nc": (_TRADE,), "cc-by-nc-sa": (_SHARE, _TRADE), "cc-by-nd": (_DERIVE,),
}
#: None of these n-grams may be there.
BARS: dict[str, tuple[str, ...]] = {
    "gpl-2.0": _NOT_GPL, "gpl-3.0": _NOT_GPL, "lgpl": ("affero", "agpl"),
    "cc-by": _SHARE + _TRADE + _DERIVE, "cc-by-sa": _TRADE + _DERIVE, "cc-by-nc": _SHARE + _DERIVE, "cc-by-nc-sa": _DERIVE, "cc-by-nd": _TRADE + _SHARE,
}
#: Sentences near the subject that declare no licence.
OTHER = (
    "You need a driving license to rent a car.", "The license plate was found in the public park.", "Please read the terms before you use the service.", "All files are copied to the source directory.",
    "The work is free to visit for the general public.", "Permission to enter the building was granted by the guard.", "Version 3 of the program was released in May.", "The rights of the author are discussed in chapter two.",
    "Every person obtaining a copy of the form signs it.", "Hotel rooms are reserved for all guests.", "The software may be sold in binary form only.", "This library is open to any person from nine to five.",
    "All rights reserved by the tenant end with the lease.", "No rights are reserved for later visitors.",
)
#: Notices of families that are not told apart. The first half of them trains `unknown`, the other sets the threshold.
STRANGE = (
    "Licensed under the Artistic License 2.0.", "This software is provided 'as-is', without any express or implied warranty, under the zlib license.", "Distributed under the Boost Software License, Version 1.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.", "Licensed under the Academic Free License version 3.0.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Released under the PostgreSQL License.", "Licensed under the Open Software License version 3.0.",
    "This work is licensed under the Free Art License 1.3.", "This program is licensed under the CeCILL license version 2.1.", "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: Artistic-2.0",
)
#: Words too common to make an n-gram worth a look.
STOP = frozenset("a all an and any are as at be by copy for from in is it may no not of on or part that the this to use used was with without work you your 0 1 2 3 4 v \x01".split(" "))
#: Each template holds one of these.
ANCHORS = "(?i)licen[cs]e|permission|redistribution|reserved|domain"
#: The end of a sentence, as a word.
STOP_WORD = "\x01"
_ENDS = r"(?<!\b[vV])[.!?](?=[\s\"')\]]|$)"
_BETWEEN = r"[^0-9a-z\x01\x{80}-\x{10ffff}]+"
UNKNOWN = "unknown"
CLASSES = (*TEMPLATES, UNKNOWN)
VARIANTS = 24
#: Known word pairs further apart than this many words belong to different candidates.
GAP = 12
#: So many words on either side of a candidate belong to it: pairs of common words are not known (`4 0`).
AROUND = 3
#: A template of fewer n-grams must be there whole.
SHORT = 12
#: Weights lie in so many maps, so that a lookup meets few keys.
BUCKETS = 512


def words_of(text: str) -> list[str]:
    """Words of a block: lower-cased in A-Z, with the ends of its sentences and its own."""
    t = re.sub(_ENDS, f" {STOP_WORD} ", text.replace(STOP_WORD, " ")) + f" {STOP_WORD}"
    t = "".join(c.lower() if c in string.ascii_uppercase else c for c in t)
    words = [w for w in re.split(r"[^0-9a-z\x01\x80-\U0010ffff]+", t) if w]
    return [w for i, w in enumerate(words) if w != STOP_WORD or (i and words[i - 1] != STOP_WORD)]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    temperature: float
    threshold: float

    @functools.cached_property
    def pairs(self) -> frozenset[str]:
        """The word pairs by which candidates are found."""
        return frozenset(g for g in self.features if g.count(" ") == 1)

    @functools.cached_property
    def templates(self) -> list[list[list[str]]]:
        known = set(self.features)
        return [[sorted(grams_of(words_of(t)) & known) for t in TEMPLATES[c]] for c in TEMPLATES]

    @functools.cached_property
    def taken(self) -> list[list[str]]:
        """What goes with a family once it is found."""
        return [sorted({g for t in ts for g in t} | {g for group in NEEDS.get(c, ()) for g in group}) for c, ts in zip(TEMPLATES, self.templates, strict=True)]


def _variants(r: random.Random) -> list[tuple[list[str], int]]:
    filler = [w for t in OTHER for w in words_of(t)]

    def varied(w: list[str], noise: float) -> list[str]:
        x = list(w)
        if len(x) > 16 and r.random() < 0.5:  # an excerpt
            n = r.randrange(max(10, len(x) // 3), len(x))
            a = r.randrange(len(x) - n + 1)
            x = x[a : a + n]
        x = [y if len(w) < 8 or r.random() > noise else r.choice(filler) for y in x]
        return [r.choice(filler) for _ in range(r.randrange(4))] + x + [r.choice(filler) for _ in range(r.randrange(4))]

    rows = []
    for i, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            w = words_of(t)
            rows += [(w, i), (w[:-1], i)]
            for _ in range(VARIANTS - 2):
                x = varied(w, 0.04)
                have = grams_of(x)
                told = all(have & set(group) for group in NEEDS.get(family, ())) and not have & set(BARS.get(family, ()))
                rows.append((x, i if told else len(CLASSES) - 1))
    every = [w for ts in TEMPLATES.values() for t in ts for w in words_of(t)]
    for v in range(VARIANTS * 30):  # the same words without their order, and neighbouring subjects
        x = [r.choice(every) for _ in range(r.randrange(3, 25))] if v % 2 else words_of(r.choice(OTHER)) + [r.choice(filler) for _ in range(r.randrange(6))]
        rows.append((x, len(CLASSES) - 1))
    for t in STRANGE[: len(STRANGE) // 2]:
        rows += [(varied(words_of(t), 0.04), len(CLASSES) - 1) for _ in range(VARIANTS)]
    return rows


@functools.lru_cache(maxsize=4)
def trained(seed: int = 7, steps: int = 150, l2: float = 2e-4) -> Model:
    """Fit weights on four fifths of the variants, temperature and threshold on the others and on families never shown."""
    r = random.Random(seed)
    rows = _variants(r)
    r.shuffle(rows)
    telling = {g for groups in NEEDS.values() for group in groups for g in group} | {g for bars in BARS.values() for g in bars}
    known = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(words_of(t)) if set(g.split(" ")) - STOP} | telling)
    at = {g: i for i, g in enumerate(known)}

    def matrix(texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(known)), np.float32)
        for i, w in enumerate(texts):
            x[i, [at[g] for g in grams_of(w) if g in at]] = 1
        return x

    x, y = matrix([w for w, _ in rows]), np.array([c for _, c in rows])
    n = len(rows) * 4 // 5
    one = np.eye(len(CLASSES), dtype=np.float32)[y]
    w, b = np.zeros((len(known), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    b[-1] = 3.0  # a paragraph without a known n-gram is unknown
    moved = np.full(w.shape, 1e-8, np.float32)
    for _ in range(steps):
        p = _softmax(x[:n] @ w + b)
        g = x[:n].T @ (p - one[:n]) / n + l2 * w
        moved += g * g
        w -= 0.15 * g / np.sqrt(moved)
    w = np.round(w.astype(float), 4)
    w[np.abs(w) < 0.02] = 0.0
    z = x[n:] @ w + b
    temperature = min((t / 10 for t in range(2, 40)), key=lambda t: -np.log(np.maximum(1e-12, _softmax(z / t)[np.arange(len(z)), y[n:]])).mean())
    unseen = matrix([words_of(t) for t in STRANGE[len(STRANGE) // 2 :]])
    strange = np.concatenate([_against(z[y[n:] == len(CLASSES) - 1], temperature), _against(unseen @ w + b, temperature)])
    threshold = round(float(max(0.5, min(0.9, np.quantile(strange, 0.98)))), 6)
    return Model(tuple(known), tuple(tuple(map(float, v)) for v in w), tuple(map(float, b)), float(temperature), threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _against(z: np.ndarray, temperature: float) -> np.ndarray:
    """How likely the likeliest family is, against unknown alone."""
    return 1 / (1 + np.exp((z[:, -1] - z[:, :-1].max(1)) / temperature))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _fixed(value, schema: str) -> Column:
    """A literal of any size: Spark reads it once, when it folds constants."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _words(text: Column) -> Column:
    """words_of()."""
    t = F.concat(F.regexp_replace(F.translate(text, STOP_WORD, " "), F.lit(_ENDS), F.lit(f" {STOP_WORD} ")), F.lit(f" {STOP_WORD}"))
    words = F.array_remove(F.split(F.translate(t, string.ascii_uppercase, string.ascii_lowercase), _BETWEEN, -1), "")
    return _let(words, lambda w: F.filter(w, lambda x, i: (x != STOP_WORD) | ((i > 0) & (F.get(w, i - 1) != STOP_WORD))))


def _blocks(text: Column) -> Column:
    """Structs of pos (first line), n_lines and text: the lines between lines without a word, of blocks with an anchor."""

    def cut(lines: Column) -> Column:
        full = F.transform(lines, lambda x: x.rlike(r"[0-9A-Za-z\x{80}-\x{10ffff}]"))
        return _let(F.struct(lines.alias("lines"), full.alias("full")), edges)

    def edges(s: Column) -> Column:
        each = F.sequence(F.lit(0), F.size(s["full"]) - 1)
        off = lambda i: ~F.coalesce(F.when(i >= 0, F.get(s["full"], i)), F.lit(False))
        first = F.filter(each, lambda i: ~off(i) & off(i - 1))
        last = F.filter(each, lambda i: ~off(i) & off(i + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("pos"), (b - a + 1).alias("n_lines"), F.array_join(F.slice(s["lines"], a + 1, b - a + 1), "\n").alias("text")))

    return F.filter(_let(F.split(text, "\n", -1), cut), lambda b: b["text"].rlike(ANCHORS))


def _candidates(words: Column, m: Model, gap: int) -> Column:
    """The word arrays of the runs in which known pairs follow each other within gap words."""
    pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)).isin(*sorted(m.pairs))
    hits = F.when(F.size(words) > 1, F.filter(F.sequence(F.lit(0), F.size(words) - 2), pair)).otherwise(F.array().cast("array<int>"))

    def cut(h: Column) -> Column:
        first = F.filter(h, lambda p, j: (j == 0) | (p - F.get(h, j - 1) > gap))
        last = F.filter(h, lambda p, j: (j == F.size(h) - 1) | (F.get(h, j + 1) - p > gap))
        start = lambda a: F.greatest(a - AROUND, F.lit(0))
        return F.zip_with(first, last, lambda a, b: F.slice(words, start(a) + 1, b + 2 + AROUND - start(a)))

    return _let(hits, cut)


def _known_grams(words: Column, features: Column) -> Column:
    def at(n: int) -> Column:
        many = F.sequence(F.lit(0), F.size(words) - n)
        return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(many, lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(n)))))

    return F.array_intersect(F.concat(words, at(2), at(3)), features)


def scan(docs: DataFrame, model: Model | None = None, *, key: str = "doc_id", text: str = "text", gap: int = GAP) -> DataFrame:
    """key, n_lines and found.

    found: structs of pos (the block's first line), part (the candidate within the block, from 0), family, probability
    (against unknown), likeness (share of the nearest template) and confirmed.
    """
    m = model or trained()
    features = _fixed(m.features, "array<string>")
    maps: list[dict[str, tuple[float, ...]]] = [{} for _ in range(BUCKETS)]
    for g, w in zip(m.features, m.weights, strict=True):
        maps[zlib.crc32(g.encode()) % BUCKETS][g] = w
    weights, bias = _fixed(maps, "array<map<string,array<double>>>"), _fixed(m.bias, "array<double>")
    names, templates, taken = _fixed(CLASSES, "array<string>"), _fixed(m.templates, "array<array<array<string>>>"), _fixed(m.taken, "array<array<string>>")
    needs = _fixed([NEEDS.get(c, ()) for c in TEMPLATES], "array<array<array<string>>>")
    bars = _fixed([BARS.get(c, ()) for c in TEMPLATES], "array<array<string>>")
    found_type = "struct<family:string,probability:double,likeness:double,confirmed:boolean>"
    state = f"struct<left:array<string>,found:array<{found_type}>>"
    nothing = F.array().cast("array<string>")

    def families(grams: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            left = acc["left"]
            weight = lambda g: F.element_at(F.get(weights, (F.crc32(g) % BUCKETS).cast("int")), g)
            logits = F.aggregate(left, bias, lambda a, g: F.zip_with(a, weight(g), lambda x, y: x + y))

            def best(z: Column) -> Column:
                top = F.array_max(F.transform(F.slice(z, 1, len(TEMPLATES)), lambda v, i: F.struct(v.alias("z"), (-i).alias("i"))))
                total = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp((v - top["z"]) / m.temperature))
                p = 1 / (1 + F.exp((F.element_at(z, len(CLASSES)) - top["z"]) / m.temperature))
                return F.struct((1 - top["i"]).alias("i"), p.alias("p"), (1 / total).alias("alone"))

            def compared(x: Column) -> Column:
                share = lambda t: F.struct((F.size(F.array_intersect(grams, t)) / F.size(t)).alias("of"), (F.size(F.array_intersect(left, t)) / F.size(left)).alias("text"), (F.size(t) < SHORT).alias("short"))
                shares = F.transform(F.element_at(templates, x["i"]), share)
                part = F.when(x["alone"] >= m.threshold, 0.5).otherwise(0.8)
                near = F.exists(shares, lambda s: (s["of"] >= F.when(s["short"], 1.0).otherwise(part)) | ((s["text"] >= 0.8) & (F.size(left) >= 20)))
                told = F.forall(F.element_at(needs, x["i"]), lambda g: F.arrays_overlap(g, grams)) & ~F.arrays_overlap(F.element_at(bars, x["i"]), grams)
                return F.struct(x["i"].alias("i"), x["p"].alias("p"), F.array_max(F.transform(shares, lambda s: s["of"])).alias("alike"), (near & told).alias("sure"))

            def judge(x: Column) -> Column:
                family = F.element_at(names, x["i"])
                found = F.struct(family.alias("family"), x["p"].alias("probability"), x["alike"].alias("likeness"), x["sure"].alias("confirmed")).cast(found_type)
                rest = F.when(x["sure"], F.array_except(left, F.element_at(taken, x["i"]))).otherwise(nothing)
                return F.struct(rest.alias("left"), F.array_append(acc["found"], found).alias("found")).cast(state)

            ended = F.struct(nothing.alias("left"), acc["found"].alias("found")).cast(state)
            likely = lambda x: F.when(x["p"] >= m.threshold, _let(compared(x), judge)).otherwise(ended)
            return F.when(F.size(left) == 0, acc).otherwise(_let(_let(logits, best), likely))

        start = F.struct(grams.alias("left"), F.array().cast(f"array<{found_type}>").alias("found")).cast(state)
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(TEMPLATES))), start, step, lambda acc: acc["found"])

    def of_block(b: Column) -> Column:
        def of_part(words: Column, part: Column) -> Column:
            place = lambda f: F.struct(b["pos"].alias("pos"), part.alias("part"), f["family"].alias("family"), f["probability"].alias("probability"), f["likeness"].alias("likeness"), f["confirmed"].alias("confirmed"))
            return F.transform(_let(_known_grams(words, features), families), place)

        return F.flatten(_let(_words(b["text"]), lambda w: F.transform(_candidates(w, m, gap), of_part)))

    t = F.coalesce(F.col(text), F.lit(""))
    n_lines = F.when(t == "", 0).otherwise(F.size(F.split(t, "\n", -1))).cast("long")
    none = F.array().cast("array<struct<pos:int,part:int,family:string,probability:double,likeness:double,confirmed:boolean>>")
    found = F.when(t.rlike(ANCHORS), F.flatten(F.transform(_blocks(t), of_block))).otherwise(none)
    return docs.select(F.col(key), n_lines.alias("n_lines"), found.alias("found"))


def notices(found: Column) -> Column:
    """The confirmed families as structs of pos, part and family. One that follows its like directly, in the next block or candidate, is the same notice going on."""
    sure = F.filter(found, lambda x: x["confirmed"])
    return _let(sure, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["family"] != x["family"])))


def op3(spark, sf_dir: str) -> DataFrame:
    """licences: the families confirmed; n_confirmed: their notices; n_unconfirmed: candidates whose likeliest family the comparison refused."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("found", lambda x: x["confirmed"])
    return rows.select(
        "doc_id", "n_lines", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licences"),
        F.size(notices(F.col("found"))).cast("long").alias("n_confirmed"), (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"), F.round(F.array_max(F.transform("found", lambda x: x["probability"])), 6).alias("probability"),
    )
