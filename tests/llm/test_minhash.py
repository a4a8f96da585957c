import random

import duckdb
import numpy as np

from svgloom.llm import minhash as mh


def sets(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)} if len(ws) >= 4 else ({tuple(ws)} if ws else set())


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(s[a] & s[b])
            if n and 100 * n >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def group(rng, n, size=80, edits=3):
    base = [f"w{rng.randint(0, 999)}" for _ in range(size)]
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(size)] = f"x{rng.randint(0, 10**9)}"
        yield " ".join(ws)


def test_as_brute_force(spark):
    rng = random.Random(5)
    texts = [*group(rng, 60), *group(rng, 30, edits=6), *group(rng, 12, 40), *(" ".join(f"w{rng.randint(0, 50)}" for _ in range(60)) for _ in range(40))]
    passage = " ".join(f"p{k}" for k in range(50))
    texts += [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 40))) for _ in range(60)]
    texts += ["one two", "One TWO", "", None, "a b c d", "A b\tc\nd", "É b c d", "é b c d", "word " * 5000]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, None), (1, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in mh.near_duplicates(docs).collect()))
    assert got == [(0, 2, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False)]
    assert mh.near_duplicates(docs.limit(0)).count() == 0


def test_all_texts_of_an_id_are_linked(spark):
    rng = random.Random(9)
    long, short = (" ".join(f"w{rng.randint(0, 999)}" for _ in range(n)) for n in (60, 20))
    docs = spark.createDataFrame([(1, long), (1, short), (2, short), (3, long + " end"), (4, "other words stand here alone"), (1, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in mh.near_duplicates(docs).collect())
    assert got == [(1, 0, 1, True), (1, 17, 1, True), (1, 57, 1, True), (2, 17, 1, False), (3, 58, 1, False), (4, 2, 4, True)]


def test_pairs_at_the_threshold_collide_often_enough():
    rng = np.random.default_rng(3)
    few = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 80, dtype=np.uint64)
        pair = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(2)]
        coords, _, _ = mh.signatures(pair)
        few += int((coords[0] == coords[1]).sum() < mh.MATCHES)
    assert few == 0


def test_long_lists_lose_no_link(spark, monkeypatch):
    rng = random.Random(6)
    texts = [*group(rng, 25), *group(rng, 25, edits=8), *group(rng, 20, 30)]
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for short in (2, 1000):
        monkeypatch.setattr(mh, "SHORT", short)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(docs).collect()} == brute(rows)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({mh.OP2_SQL})").fetchall())
    got = sorted(tuple(r) for r in mh.op2_minhash(spark, sf).collect())
    assert got == want and not all(r[3] for r in got)
