import random

import duckdb
import hashlib
import numpy as np

from svgloom.llm import suffix_dedup as sd


def brute(rows):
    """Removed runs of each document, by all strings of 100 bytes in a dictionary."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, np.int64)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                cover[p] += 1
                cover[p + 100] -= 1
            seen.add(w)
        gone = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        out[i] = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "and", "größe", "x", "alpha", "beta" * 3, str(rng.randint(0, 99))])
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(15, 120)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            t += s[a : rng.randint(a, len(s))] + text(rng.randint(0, 20))
        rows.append((i, t))
    rows += [(n, rows[3][1]), (n + 1, rows[4][1][:300] + "!" + rows[4][1][301:]), (n + 2, "a" * 1500), (n + 3, "ab" * 700 + "c" + "ab" * 100), (n + 4, "a" * 99), (n + 5, "a" * 100), (n + 6, "".join(chr(33 + k) for k in range(90)) * 9), (n + 7, "")]
    return rows


def test_bwt_is_that_of_all_suffixes(tmp_path):
    rng = np.random.default_rng(2)
    strings = [rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8) for _ in range(50)]
    c = sd.Collection(strings, str(tmp_path))
    bwt, lcp = c.build()
    s, o = c.places(bwt)
    want = sorted((strings[i][k:].tobytes(), k == len(strings[i]), i, k) for i in range(50) for k in range(len(strings[i]) + 1))
    got = [strings[i][k:].tobytes() for i, k in zip(s, o)]
    assert got == [w[0] for w in want]
    for a in range(1, len(got)):
        k = 0
        while k < min(len(got[a]), len(got[a - 1])) and got[a][k] == got[a - 1][k]:
            k += 1
        assert lcp[a] == k
    for i, k, b in zip(s, o, bwt):
        assert b == (0 if k == 0 else strings[i][k - 1] + 1)


def test_as_brute_force(spark):
    for hot in (20_000, 1):
        rows = corpus(hot)
        random.Random(1).shuffle(rows)
        docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, p int").repartition(3)
        want = brute(rows)
        for r in sd.dedup_bytes(docs, hot).collect():
            assert [(x.a, x.b) for x in r.spans] == want[r.doc_id], r.doc_id
            raw = dict(rows)[r.doc_id].encode()
            assert bytes(r.kept) == b"".join(raw[a:b] for a, b in zip([0, *[y for _, y in want[r.doc_id]]], [*[x for x, _ in want[r.doc_id]], len(raw)]))


def test_edges(spark):
    t = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, t), (None, t), (2, None), (3, t), (3, t), (4, "x"), (5, "q" + " ".join(f"other{k}" for k in range(40))), (5, "q" + " ".join(f"other{k}" for k in range(40)))], "doc_id long, text string")
    got = sorted((r.doc_id or 0, len(r.kept)) for r in sd.dedup_bytes(docs).collect())
    n = len("q" + " ".join(f"other{k}" for k in range(40)))
    assert got == [(0, len(t)), (1, 0), (2, 0), (3, 0), (3, 0), (4, 1), (5, n), (5, n)]
    assert sd.dedup_bytes(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want = brute(rows)
    texts = {i: (t or "").encode() for i, t in rows}
    for r in sd.op1_suffix_dedup(spark, sf).collect():
        cut = want[r.doc_id]
        raw = texts[r.doc_id]
        kept = b"".join(raw[a:b] for a, b in zip([0, *[y for _, y in cut]], [*[x for x, _ in cut], len(raw)]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(y - x for x, y in cut), len(cut), hashlib.sha256(kept).hexdigest())


def test_many_texts_without_an_id_are_told_apart(spark):
    rng = random.Random(8)
    texts = [" ".join(str(rng.random()) for _ in range(9)) for _ in range(3000)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(None, texts[0])], "doc_id long, text string")
    got = sd.dedup_bytes(docs).collect()
    assert len(got) == 3001 and not any(r.spans for r in got)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({sd.OP1_SQL})").fetchall())
    got = sorted(tuple(r) for r in sd.op1_suffix_dedup(spark, sf).collect())
    assert got == want and any(r[2] for r in got)
