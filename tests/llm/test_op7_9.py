import random
import re

import duckdb
import pytest

from rankeval.llm import line_dedup, quality_rules

SF = "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\x0c\r"


def same(df, sql, tables):
    c = duckdb.connect()
    for name, source in tables.items():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    got = sorted(map(tuple, df.collect()))
    want = c.sql(sql)
    assert df.columns == want.columns
    assert got == sorted(want.fetchall())


@pytest.mark.parametrize("op,sql", [(line_dedup.op9, line_dedup.ORACLE), (quality_rules.op7, quality_rules.ORACLE)])
def test_against_sql(spark, op, sql):
    same(op(spark, SF), sql, {"documents": f"{SF}/documents.parquet"})



def test_line_dedup_edges(spark):
    long = "A Line that Repeats"
    docs = [(3, f"{long}\nshort\n\n"), (1, f" {long.upper()}\t\nshort"), (1, f" {long.upper()}\t\nshort"), (2, None), (4, ""), (5, f"{long}\n{long}\r"), (None, f"{long}\nmore"), (6, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé"), (7, "ÉÉÉÉÉÉÉÉÉÉ"), (8, "x " * 40000 + "\nown line here"), (None, "own line here")]
    df = spark.createDataFrame([(d, t, 9, 9) for d, t in docs], "doc_id long, text string, pos int, n_lines int")
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1] == [(docs[1][1], 2, 0)] * 2 and by[3] == [("short\n\n", 4, 1)] and by[5] == [("", 2, 2)]
    assert by[2] == [(None, 1, 0)] and by[4] == [("", 1, 0)]
    assert sorted(by[None]) == [("", 1, 1), ("more", 2, 1)]
    assert by[6] == [(docs[7][1], 2, 0)] and by[7] == [("", 1, 1)] and by[8][0][2] == 0
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_rules_against_brute_force(spark):
    r = random.Random(6)
    docs = []
    for i in range(120):
        words = [r.choice(["aa", "b", "c|", "é", "#", "dd\n", "e"]) for _ in range(r.randrange(0, 60))]
        docs.append((i, r.choice([" ", "\t", "\n"]).join(words * r.choice([1, 1, 2]))))
    docs += [(500, None), (501, ""), (502, " \n "), (502, " \n "), (None, "x"), (503, "w " * 30000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_words int")
    want = []
    for d, t in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        hit = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.strip(BLANK)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit)))
    got = quality_rules.ledger(df)
    assert sorted((tuple(x)[:-1] for x in got.collect()), key=str) == sorted(want, key=str)
    failed = [x.failed for x in got.collect()]
    policy = quality_rules.mask_of(quality_rules.POLICIES["v1"])
    for row in quality_rules.ablations(got, "v1").collect():
        bit = quality_rules.mask_of([row.rule])
        assert (row.fails, row.alone, row.kept_without) == (sum(bool(f & bit) for f in failed), sum(f & policy == bit for f in failed), sum(not f & policy & ~bit for f in failed))
    assert quality_rules.ledger(df.limit(0)).count() == 0
