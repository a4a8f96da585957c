import hashlib
import os

import duckdb

from svgloom.llm import line_dedup as ld


def brute(rows, need):
    """Texts left, by id: whole sequences of lines compared as they are."""
    seqs = {i: t.split("\n") for i, t in rows}
    seen, cut = set(), {i: set() for i in seqs}
    for i in sorted(seqs):
        ls = seqs[i]
        for a in range(len(ls)):
            n = 0
            for b in range(a, len(ls)):
                n += max(1, len("".join(ls[b].split())))
                if n >= need:
                    key = tuple(ls[a : b + 1])
                    if key in seen:
                        cut[i] |= set(range(a, b + 1))
                    seen.add(key)
                    break
    return {i: "\n".join(x for k, x in enumerate(ls) if k not in cut[i]) for i, ls in seqs.items()}


def test_as_brute_force(spark):
    import random

    rng = random.Random(3)
    vocab = ["a", "b b", "c c c", "", "d " * 9, "e"]
    rows = [(i, "\n".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, rows[5][1]), (101, rows[6][1] + "\nz\n" + rows[7][1]), (102, "same\n" * 50), (103, "x\n" * 40 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for need in (1, 3, 7, 20):
        got = {r.doc_id: r.text for r in ld.dedup_lines(docs, need).collect()}
        assert got == brute(rows, need), need


def test_edges(spark):
    long = "\n".join(f"line {k} of a long text" for k in range(3000))
    rows = [(None, "one two\n" * 15, "c"), (1, None, "c"), (2, "", "c"), (3, long, None), (4, long, "c"), (5, "one two\n" * 15, "c"), (4, long, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run string")
    out = ld.dedup_lines(docs)
    assert out.columns[:3] == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] is None and by[2] == "" and by[3] == long and by[4] == "" and by[5] == ""
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, n_runs, kept_sha256 FROM ({ld.OP10_SQL})").fetchall())
    got = sorted(tuple(r) for r in ld.op10_line_dedup(spark, sf).collect())
    assert got == want and any(r[2] for r in got)
