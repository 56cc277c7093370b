import math
import random
import re

from rankeval.llm import licences

SF = "/root/testdata/sf0.01"
#: Families that neither the templates nor the fitted unknown class know.
UNSEEN = (
    "Licensed under the EUPL, Version 1.2 or later.", "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: WTFPL", "Licensed under the Microsoft Public License.",
    "Licensed under the University of Illinois Open Source License.", "Released under the Python Software Foundation License, version 2.", "This file is licensed under the Educational Community License, Version 2.0.",
    "Distributed under the Perl license.", "Released under the Vim License.", "This work is licensed under the Mulan Permissive Software License v2.", "SPDX-License-Identifier: NCSA", "SPDX-License-Identifier: PHP-3.01",
    "Licensed under the Business Source License 1.1.", "Licensed under the Elastic License 2.0.", "Subject to the Server Side Public License, version 1.", "Available under the Sleepycat License.",
    "Licensed under the X11 license.", "Open Data Commons Open Database License v1.0", "Licensed under the Nokia Open Source License 1.0a.", "This program is licensed under the Reciprocal Public License 1.5.",
)


def families(words, m, at):
    """(family, probability, confirmed), one after the other."""
    grams, out = licences.grams_of(words) & set(at), []
    left = grams
    while left:
        z = [b + sum(m.weights[at[g]][c] for g in left) for c, b in enumerate(m.bias)]
        c = max(range(len(licences.TEMPLATES)), key=lambda i: (z[i], -i))
        p = 1 / (1 + math.exp((z[-1] - z[c]) / m.temperature))
        if p < m.threshold:
            break
        family = licences.CLASSES[c]
        part = 0.5 if 1 / sum(math.exp((v - z[c]) / m.temperature) for v in z) >= m.threshold else 0.8
        shares = [(len(grams & set(t)) / len(t), len(left & set(t)) / len(left), len(t) < licences.SHORT) for t in m.templates[c]]
        near = any(a >= (1 if short else part) or (b >= 0.8 and len(left) >= 20) for a, b, short in shares)
        told = all(grams & set(g) for g in licences.NEEDS.get(family, ())) and not grams & set(licences.BARS.get(family, ()))
        out.append((family, round(p, 6), round(max(a for a, _, _ in shares), 6), near and told))
        left = left - set(m.taken[c]) if near and told else set()
    return out


def brute(text, m, at):
    """(pos, part, family, probability, likeness, confirmed) of a text."""
    lines, out = (text or "").split("\n"), []
    full = [bool(re.search(r"[0-9A-Za-z\x80-\U0010ffff]", x)) for x in lines]
    first = 0
    while first < len(lines):
        last = first
        while last < len(lines) and full[last] == full[first]:
            last += 1
        block = "\n".join(lines[first:last])
        if full[first] and re.search(licences.ANCHORS, block):
            w = licences.words_of(block)
            hits = [i for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" in m.pairs]
            runs = []
            for h in hits:
                if runs and h - runs[-1][1] <= licences.GAP:
                    runs[-1][1] = h
                else:
                    runs.append([h, h])
            for part, (a, b) in enumerate(runs):
                out += [(first, part, *f) for f in families(w[max(0, a - licences.AROUND) : b + 2 + licences.AROUND], m, at)]
        first = last
    return out


def test_against_brute_force(spark):
    m, r = licences.trained(), random.Random(4)
    at = {g: i for i, g in enumerate(m.features)}
    every = [w for ts in licences.TEMPLATES.values() for t in ts for w in t.split()]
    lines = [t for ts in licences.TEMPLATES.values() for t in ts] + list(licences.OTHER + licences.STRANGE + UNSEEN) + ["", " * ", ""] * 9 + [" ".join(r.choice(every) for _ in range(r.randrange(2, 40))) for _ in range(150)]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "é中\nALL RIGHTS RESERVED."), (503, "é中\nALL RIGHTS RESERVED."), (None, lines[0]), (504, "license " * 30000 + "\n" + lines[2]), (505, "\x01 .MIT\x01License.. !"), (506, "license"), (507, "Licence\r\n\r\nMIT License")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, found string")
    got = sorted(((r.doc_id, r.n_lines, [(f.pos, f.part, f.family, round(f.probability, 6), round(f.likeness, 6), f.confirmed) for f in r.found]) for r in licences.scan(df).collect()), key=str)
    want = sorted(((d, (t.count("\n") + 1) if t else 0, brute(t, m, at)) for d, t in docs), key=str)
    assert got == want
    assert sum(len(f) for _, _, f in got) > 100 and any(not x[5] for _, _, f in got for x in f)
    assert licences.scan(df.limit(0)).count() == 0


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[f.family for f in r.found if f.confirmed] for r in licences.scan(df).orderBy("doc_id").collect()]


def test_templates_are_found_and_other_lines_are_not(spark):
    rows = [(c, t) for c, ts in licences.TEMPLATES.items() for t in ts] + [("", t) for t in licences.OTHER + licences.STRANGE]
    assert all(re.search(licences.ANCHORS, t) for c, t in rows if c)
    wrong = [(c, t, got) for (c, t), got in zip(rows, found(spark, [t for _, t in rows]), strict=True) if got != [c for c in [c] if c]]
    assert not wrong


def test_families_held_out_are_unknown(spark):
    got = found(spark, UNSEEN)
    assert [(t, f) for t, f in zip(UNSEEN, got, strict=True) if f] == []


def test_versions_and_sisters(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    want = {
        gnu.format("General", 2): ["gpl-2.0"], gnu.format("General", 3): ["gpl-3.0"], gnu.format("Affero General", 3): ["agpl-3.0"], gnu.format("Lesser General", "2.1"): ["lgpl"],
        "Licensed under CC BY-SA 4.0.": ["cc-by-sa"], "Licensed under CC BY-NC-SA 3.0.": ["cc-by-nc-sa"], "Licensed under CC BY 4.0.": ["cc-by"],
        "SPDX-License-Identifier: MIT": ["mit"], "SPDX-License-Identifier: Apache-2.0": ["apache-2.0"], "// SPDX-License-Identifier: GPL-2.0-only\nint x;": ["gpl-2.0"], "SPDX-License-Identifier: EPL-2.0": ["epl-2.0"],
        "MIT License": ["mit"], "This project is licensed under the terms of the MIT license.": ["mit"],
        "Licensed under the GNU General Public License.": [], "Licensed under the Apache License, Version 1.1.": [],
        "All rights reserved by the hotel.": [], "no rights reserved, unlike all rights reserved works": [], "Copyright 2020 A. Person. All rights reserved.": ["proprietary"],
    }
    assert dict(zip(want, found(spark, list(want)), strict=True)) == want


def test_query_stays_on_the_jvm(spark):
    plan = licences.op3(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_wrapped_double_and_buried_notices(spark, tmp_path):
    mit, apache = licences.TEMPLATES["mit"], licences.TEMPLATES["apache-2.0"]
    comment = lambda text, n: "\n".join(" * " + " ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    r = random.Random(1)
    prose = " ".join(r.choice(["the", "work", "of", "software", "public", "rivers", "general", "stone", "version", "permission", "and", "house"]) for _ in range(20000))
    rows = [
        ("proprietary", "intro\nAll rights\nreserved.\n"), ("mit", "Released under the\nMIT License."), ("cc-by-nc", "Licensed under CC\nBY-NC 4.0."),
        ("", "All rights\n\nreserved."), ("apache-2.0,mit", f"{mit[0]} {apache[0]}"), ("mit,proprietary", "All rights reserved. Released under the\nMIT License."),
        ("apache-2.0", "\n".join(apache[1].split())), ("cc-by", "Licensed under CC BY 4.0."), ("", "a\nb"), ("", None),
        ("mit", comment(mit[3], 9)), ("mit", f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{comment(mit[3], 4)}"), ("mit", f"{prose} {mit[3]} {prose}"), ("", prose),
    ]
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in licences.op3(spark, str(tmp_path)).collect()}
    assert [got[i].licences for i in range(len(rows))] == [c for c, _ in rows]
    assert [got[i].n_confirmed for i in (0, 1, 2, 3, 4, 5, 7, 10, 11, 12)] == [1, 1, 1, 0, 2, 2, 1, 1, 1, 1]
