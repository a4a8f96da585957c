import math

import duckdb
import numpy as np

from svgloom.llm import cap_dedup as cd


def brute(rows):
    good = [(i, np.array(e, float), l) for i, e, l in rows if i is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    up, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[k + 1 :]:
            if la == lb and len(a) == len(b) and cd.cosine(a, b) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (links[i], find(i)) for i in up}


def test_as_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for _ in range(12):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 60)):
            x = base + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.13, 0.2])
            rows.append((i, x.astype(np.float32).tolist(), int(rng.integers(0, 2))))
            i += 1
    for _ in range(150):
        rows.append((i, rng.standard_normal(64).tolist(), 1))
        i += 1
    rows += [(i, None, 1), (i + 1, [0.0] * 64, 1), (i + 2, [1.0, None] * 32, 1), (i + 3, [float("nan")] * 64, 1), (i + 4, [1e300] * 64, 1), (i + 5, [1e-300] * 64, 1), (i + 6, rows[0][1], None), (i + 7, [], 1), (i + 8, [1.0, 2.0], 1), (i + 9, [2.0, 4.0], 1)]
    want = brute([r for r in rows if r[0] not in (i + 4, i + 5)])
    want |= {i + 4: (1, i + 4), i + 5: (1, i + 4)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for most in (1024, 16):
        monkeypatch.setattr(cd, "BUCKET", most)
        got = {r.vec_id: (r.n_links, r.component_id) for r in cd.near_duplicates(df).collect()}
        assert len(got) == len(rows)
        assert got == want
    assert cd.near_duplicates(df.limit(0)).count() == 0


def test_list_decoding_is_complete():
    code = cd.Code(64, 50_000)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((5, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sums = code._sums(x @ code.rotation)
    for k, got in enumerate(code.filters(x)):
        total = sums[0][k]
        for s in sums[1:]:
            total = np.add.outer(total, s[k])
        every = np.flatnonzero(total.ravel() > code.threshold)
        if len(every) >= cd.LEAST:
            assert (got == every).all()


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({cd.OP5_SQL})").fetchall())
    assert sorted(tuple(r) for r in cd.op5_cap_dedup(spark, sf).collect()) == want


def test_recall_at_the_threshold():
    # pairs at exactly the least cosine, in codes for few and for very many vectors
    rng = np.random.default_rng(4)
    for dimension, vectors in ((16, 10_000), (64, 500), (64, 1_000_000), (64, 50_000_000), (256, 1_000_000)):
        code = cd.Code(dimension, vectors)
        x = rng.standard_normal((400, dimension))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((400, dimension))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        near = cd.COSINE * x + np.sqrt(1 - cd.COSINE**2) * y
        found = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(code.filters(x), code.filters(near))])
        print("recall", dimension, vectors, found)
        assert found >= 0.98, (dimension, vectors, found)


def test_other_columns_may_have_any_name(spark):
    rows = [(1, [1.0, 0.0], "a", 5, 6.0), (2, [1.0, 0.0], "a", 7, 8.0), (3, [0.0, 1.0], "a", None, None), (4, None, "a", 1, 1.0), (5, [1.0, 0.0], None, 1, 1.0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n_links int, rep double")
    assert sorted(tuple(r) for r in cd.near_duplicates(v).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
