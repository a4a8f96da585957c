"""Embedding near-duplicates by spherical-cap filters.

Filter directions form a product code: a seeded random rotation, then BLOCKS blocks of
dimensions with a random spherical subcode each; a direction takes one code word from each
block. A vector's filters are all directions whose inner product with it exceeds a
threshold, list-decoded from the sorted block products without trying every
combination; the threshold is the one that about LIST random directions exceed, and a
vector that fewer than LEAST exceed takes its LEAST best. Vectors with one label that
share a filter are compared: cosine in double precision, linked at 0.98 or more.

The code grows with the number of vectors, so that unrelated vectors share few
filters. A pair that shares several filters counts in the first of them only, which each
bucket tells from its members' filter lists, so links are counted where they are found and
pairs are never written: a bucket returns a count and one edge toward its
components for each member. A bucket of more than ``BUCKET`` vectors is cut into parts; each
two parts are compared in a task of their own. Vectors with equal label and components
are one, with a weight.

Vectors that are null, empty, zero or hold null or non-finite components, and labels that are
null, link with nothing (n_links 0, a component of their own). Vectors of different
dimensions are never linked. Repeated vec_ids keep their rows; they share one component,
and count as vectors each. Null vec_id: no links. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom.session import materialize, ship

from .common import table
from .components import components

COSINE = 0.98
BLOCKS = 4
#: Filters of a vector on average, and at least.
LIST = 24
LEAST = 20
#: Unrelated vectors in a filter on average.
TOGETHER = 1
#: Vectors that one task compares with each other.
BUCKET = 1024
#: Members of a bucket up to which its pairs are compared together with those of other buckets, and rows of a step.
SMALL = 24
ROWS = 8192
#: Filters of a vector up to which lists are compared as rows of a table.
WIDE = 48


class Code:
    """A product code for vectors of one dimension."""

    def __init__(self, dimension: int, vectors: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.dimension = dimension
        self.blocks = min(BLOCKS, max(1, dimension))
        self.width = -(-dimension // self.blocks)
        full = self.width * self.blocks
        self.rotation = np.linalg.qr(rng.standard_normal((full, full)))[0][:dimension]
        filters = max(1.0, vectors * LIST / TOGETHER)
        self.size = int(np.clip(np.ceil(filters ** (1 / self.blocks)), 6, 96))
        words = rng.standard_normal((self.blocks, self.size, self.width))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True) / np.sqrt(self.blocks)
        # the threshold that LIST of all directions exceed, measured on random vectors
        probe = rng.standard_normal((64, full))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        sums = self._sums(probe)
        share = min(1.0, LIST / self.size**self.blocks)
        picks = rng.integers(0, self.size, (self.blocks, 20_000))
        flat = sum(sums[b][:, picks[b]] for b in range(self.blocks)).ravel()
        self.threshold = float(np.quantile(flat, 1 - share))

    def _sums(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, b * self.width : (b + 1) * self.width] @ self.words[b].T for b in range(self.blocks)]

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """The sorted filter numbers of each unit vector."""
        sums = self._sums(unit @ self.rotation)
        return [np.sort(self._decode([s[i] for s in sums])) for i in range(len(unit))]

    def _decode(self, sums: list[np.ndarray]) -> np.ndarray:
        least = self.threshold
        while True:
            got, value = self._exceed(sums, least)
            if len(got) >= min(LEAST, self.size**self.blocks):
                return got if least == self.threshold else got[np.argsort(-value, kind="stable")[:LEAST]]
            least -= 0.05

    def _exceed(self, sums: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
        """All combinations with a sum over ``least``: block by block, only prefixes that the best of the rest can lift over it."""
        rest = np.concatenate([np.cumsum([s.max() for s in sums][::-1])[::-1][1:], [0.0]])
        code, value = np.zeros(1, np.int64), np.zeros(1)
        for b, s in enumerate(sums):
            order = np.argsort(-s, kind="stable")
            total = value[:, None] + s[order][None]
            r, c = np.nonzero(total > least - rest[b])
            code, value = code[r] * self.size + order[c], total[r, c]
        return code, value


def _local_components(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id reachable within a matrix of links."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return low
        low = new


def compare(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, lists: list[np.ndarray], here: int, part: np.ndarray, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links counted and least id linked for each member of a bucket; pairs that share an earlier filter are left to it, and so are those of other parts."""
    g = np.einsum("ij,kj->ik", x, x, optimize=True)
    near = g >= COSINE - 1e-9
    np.fill_diagonal(near, False)
    for i, k in zip(*np.nonzero(near & (np.abs(g - COSINE) < 1e-9))):  # at the border: the plain formula decides
        near[i, k] = cosine(x[i], x[k]) >= COSINE
    earlier = [f[f < here] for f in lists]
    names, at = np.unique(np.concatenate(earlier), return_inverse=True) if sum(map(len, earlier)) else (np.zeros(0), np.zeros(0, np.int64))
    if len(names):
        has = np.zeros((len(ids), len(names)), np.float32)
        has[np.repeat(np.arange(len(ids)), [len(f) for f in earlier]), at] = 1
        first = has @ has.T == 0
    else:
        first = np.ones_like(near)
    across = (part[:, None] != part[None, :]) if pair[0] != pair[1] else np.ones_like(near)
    count = ((near & first & across) * weight[None, :]).sum(axis=1)
    return count, _local_components(near, ids)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def compare_small(starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, weight: np.ndarray, x: np.ndarray, lists: list[np.ndarray], here: np.ndarray, part: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`compare` for many small buckets, which follow each other in the arrays, at once."""
    count, low = np.zeros(len(ids), np.int64), ids.copy()
    left, right = [], []
    for n in np.unique(sizes).tolist():
        i, k = np.triu_indices(n, 1)
        at = starts[sizes == n][:, None]
        left.append((at + i).ravel())
        right.append((at + k).ravel())
    i, k = np.concatenate(left), np.concatenate(right)
    near = []
    for a in range(0, len(i), 1 << 17):
        c = np.einsum("ij,ij->i", x[i[a : a + (1 << 17)]], x[k[a : a + (1 << 17)]])
        sure = c >= COSINE
        for e in np.flatnonzero(np.abs(c - COSINE) < 1e-9).tolist():
            sure[e] = cosine(x[i[a + e]], x[k[a + e]]) >= COSINE
        near.append(a + np.flatnonzero(sure))
    near = np.concatenate(near) if near else np.zeros(0, np.int64)
    i, k = i[near], k[near]
    if len(i):
        width = np.array([len(f) for f in lists])
        used = np.unique(np.concatenate([i, k]))
        used = used[width[used] <= WIDE]
        table = np.full((len(ids), WIDE), -1, np.int64)
        for r in used.tolist():
            table[r, : width[r]] = lists[r]
        narrow = (width[i] <= WIDE) & (width[k] <= WIDE)
        first = np.ones(len(i), bool)  # no earlier filter holds both
        for at in np.array_split(np.flatnonzero(narrow), -(-int(narrow.sum()) // 4096) or 1):
            p, q = table[i[at]], table[k[at]]
            both = (p[:, :, None] == q[:, None, :]) & ((p >= 0) & (p < here[i[at]][:, None]))[:, :, None]
            first[at] = ~both.any(axis=(1, 2))
        for e in np.flatnonzero(~narrow).tolist():
            shared = np.intersect1d(lists[i[e]], lists[k[e]], assume_unique=True)
            first[e] = shared[0] >= here[i[e]]
        mine = first & (~across[i] | (part[i] != part[k]))
        np.add.at(count, i[mine], weight[k[mine]])
        np.add.at(count, k[mine], weight[i[mine]])
        while True:
            before = low.copy()
            np.minimum.at(low, i, before[k])
            np.minimum.at(low, k, before[i])
            if (low == before).all():
                break
    return count, low


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, rep, links, low of the members of the buckets of a task, which come in the order of their keys."""
    names = ["label", "d", "f", "p", "q"]
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> pa.RecordBatch:
        label, d, f, p, q = (t.column(n).to_numpy() for n in names)
        ids, weight, part = (t.column(n).to_numpy() for n in ("rep", "weight", "part"))
        new = np.ones(len(ids), bool)
        new[1:] = (label[1:] != label[:-1]) | (d[1:] != d[:-1]) | (f[1:] != f[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(ids)))
        flat = t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.concatenate([[0], np.cumsum(d)])
        lists = [x.values.to_numpy() for x in t.column("filters").combine_chunks()]
        count, low = np.zeros(len(ids), np.int64), ids.copy()
        for dim in np.unique(d).tolist():
            rows = np.flatnonzero(d == dim)
            x = flat[begin[rows][:, None] + np.arange(dim)]
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            place = np.full(len(ids), -1)
            place[rows] = np.arange(len(rows))
            mine = d[starts] == dim
            small = mine & (sizes <= SMALL) & (sizes > 1)
            if small.any():
                c, m = compare_small(place[starts[small]], sizes[small], ids[rows], weight[rows], x, [lists[r] for r in rows.tolist()], f[rows], part[rows], p[rows] != q[rows])
                count[rows] += c
                low[rows] = np.minimum(low[rows], m)
            for a, n in zip(starts[mine & (sizes > SMALL)].tolist(), sizes[mine & (sizes > SMALL)].tolist()):
                r = slice(a, a + n)
                at = place[r]
                count[r], low[r] = compare(ids[r], weight[r], x[at], lists[a : a + n], int(f[a]), part[r], (int(p[a]), int(q[a])))
        keep = (count > 0) | (low != ids)
        return pa.RecordBatch.from_arrays([pa.array(label[keep], pa.string()), *[pa.array(v[keep], pa.int64()) for v in (ids, count, low)]], names=["label", "rep", "links", "low"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        t = pa.Table.from_batches(held)
        keys = [t.column(n).to_numpy() for n in names]
        last = t.num_rows - 1
        same = np.logical_and.reduce([k == k[last] for k in keys])
        first = int(np.flatnonzero(same)[0])  # the last bucket may go on in the next batch
        if first:
            yield done(t.slice(0, first))
        held = t.slice(first).to_batches()
        rows = t.num_rows - first
    if rows:
        yield done(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = ship(vectors.sparkSession)
    # single precision is moved as it is; all arithmetic is in double precision
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("e"), F.col(label_col).cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.exists("e", lambda x: x != 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", F.transform("e", lambda x: (x + F.lit(0.0)).cast(kind)).alias("e"))
    groups = materialize(usable.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vectors")
    # one row for each dimension that occurs
    sizes = {r.d: r.n for r in groups.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    codes = spark.sparkContext.broadcast(pickle.dumps({d: Code(d, n) for d, n in sizes.items()}))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(codes.value)
        for batch in batches:
            e = batch.column(batch.schema.get_field_index("e"))
            lists: list = [None] * len(e)
            dims = np.diff(e.offsets.to_numpy())
            flat = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = np.stack([flat[begin[r] : begin[r] + d] for r in rows])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for r, f in zip(rows.tolist(), known[d].filters(x)):
                    lists[r] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"])

    coded = groups.mapInArrow(listed, f"label string, e array<{kind}>, rep long, weight long, filters array<long>")
    posted = coded.select("label", F.size("e").alias("d"), "e", "rep", "weight", "filters", F.explode("filters").alias("f"))
    posted = posted.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(1 << 20)))
    counts = coded.select("label", F.size("e").alias("d"), F.explode("filters").alias("f")).groupBy("label", "d", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = posted.join(counts, ["label", "d", "f"]).withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int")).withColumn("part", F.pmod("part", F.col("parts")).cast("int"))
    # a bucket in one part is one group; otherwise a member goes to the group of each two parts that hold its own
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("p"), F.greatest(o, F.col("part")).alias("q")))
    grouped = members.select("label", "d", "f", "e", "rep", "weight", "filters", "part", F.explode(pairs).alias("pq")).select("label", "d", "f", "pq.p", "pq.q", "e", "rep", "weight", "filters", "part")

    key = ["label", "d", "f", "p", "q"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_buckets = grouped.repartition(n, *key).sortWithinPartitions(*key)
    found = materialize(sorted_buckets.mapInArrow(_buckets, "label string, rep long, links long, low long").groupBy("label", "rep", "low").agg(F.sum("links").alias("links")), "cap-links")
    # a label is part of a node: one vec_id may stand in rows of several labels
    roots = components(found.where("low <> rep").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("label", "rep").agg(F.sum("links").alias("links"))
    of_rep = groups.join(links, ["label", "rep"], "left").join(roots, F.col("rep") == F.col("node"), "left").select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = usable.join(of_rep, ["label", "e"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = v.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_cap_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) AS norm FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), u AS (SELECT * FROM v WHERE norm > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, vec_id) AS component_id, coalesce(c.component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
