"""Near-duplicates by an inverted join on MinHash signature coordinates, confirmed on full shingle sets.

A document's set: the distinct shingles of four words (or another number) of its lower-cased text. Documents
with equal sets form a class; only classes are compared. A signature has ``COORDINATES`` coordinates, each a MinHash value of 64
bits: two sets of Jaccard similarity s agree in each with probability s. A class is posted under each pair of coordinate and
value, and two classes are candidates if they collide in ``MATCHES`` coordinates or more: at the threshold 0.8 a pair is missed with
probability of 1.3e-5.

Collisions are counted by prefix and skip: with a class's postings in order of the length of their lists, two
classes that collide in MATCHES coordinates share a list among the first COORDINATES - MATCHES + 1 of each. Lists of one member fill
that prefix first, so a class without a near-duplicate drops out before any pair is made. Only lists of prefixes are merged into
pairs; the longer ones are skipped, and a pair's collisions in them are looked up in the two signatures.

A short list (up to ``SHORT``) gives all its pairs. A long
list gives the pairs of its first member only; once those are confirmed, a list whose
members are in one component is skipped. From the others go those members of whose shingles too many are
in no other (they can link with none). What then shares lists is a family: its members
outside the largest component are compared with the rest, part by part, without pairs
being written. So no link between components is lost, a group of near copies costs about
one comparison for each member, and only members that are near the group but not in it cost more.

A pair is confirmed by 100 * intersection >= 80 * union over the full sets.

Null or empty text, or text without a word: an empty set, linked with nothing. Null
doc_id: no links, a component of its own (null). Rows that repeat a doc_id are kept, each with
the size of its own set; all texts of an id are compared, and what any of them links with is linked with the id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from svgloom.session import materialize

from .common import byte_randoms, lower, mix, narrow, pieces, span_hashes, table, words
from .components import components

SHINGLE = 4
PERCENT = 80
COORDINATES = 48
#: Coordinates in which a candidate pair agrees.
MATCHES = 26
#: Members of a list that is compared in full.
SHORT = 8
#: Members of a family in one part: two parts are compared in a task.
PART = 512

_RANDOMS = byte_randoms(21)
_RNG = np.random.default_rng(22)
_PLACE = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(1, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
#: Shingles that one step of the signature handles: they stay in the processor's cache.
_BLOCK = 1 << 16


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    low = lower(data)
    starts, ends, rows = words(low, offs)
    h = span_hashes(low, starts, ends, _RANDOMS)
    m = len(h) - size + 1
    full = np.zeros(max(m, 0), np.uint64)
    for k in range(size):
        full += h[k : k + max(m, 0)] * _PLACE[k]
    full = mix(full)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[size : size + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates (int64) and a 128-bit identity of each set; none may be empty."""
    coords = np.zeros((len(sets), COORDINATES), np.uint64)
    ident = np.zeros((len(sets), 2), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _BLOCK, "right")))
        x = np.concatenate(sets[a:b])
        starts = (ends[a:b] - sizes[a:b]) - (ends[a - 1] if a else 0)
        ident[a:b, 0] = np.add.reduceat(mix(x ^ np.uint64(0x1234567)), starts)
        ident[a:b, 1] = np.add.reduceat(mix(x + np.uint64(0x9876543)), starts)
        x = mix(x)
        for j in range(COORDINATES):
            # the high bits of a product depend on all bits of its factors
            coords[a:b, j] = np.minimum.reduceat((x ^ _FLIP[j]) * _MULTIPLY[j], starts)
        a = b
    return coords.view(np.int64), ident.view(np.int64), sizes


_SET_SCHEMA = "doc_id long, th long, n_shingles long, s1 long, s2 long, coords array<long>"


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, the set's identity and its coordinates (null if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in pieces(batch):
                sets = shingle_sets(data, offs, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                coords, ident, _ = signatures([sets[i] for i in full])
                at = np.full(b - a, -1)
                at[full] = np.arange(len(full))
                none = at < 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(none, 0, COORDINATES))]), pa.int32()), pa.array(coords.reshape(-1), pa.int64()))
                take = np.maximum(at, 0)
                ids = ident if len(ident) else np.zeros((1, 2), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(ids[take, 0], pa.int64(), mask=none),
                        pa.array(ids[take, 1], pa.int64(), mask=none),
                        lists,
                    ],
                    names=["doc_id", "th", "n_shingles", "s1", "s2", "coords"],
                )

    return _hashed(docs).select("doc_id", "text", "th").mapInArrow(run, _SET_SCHEMA)


def _hashed(docs: DataFrame) -> DataFrame:
    """Id, text and a hash of the text, which tells texts of one id apart."""
    return narrow(docs).withColumn("th", F.xxhash64("text"))


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets meet the threshold; the texts of both are joined to the pair."""
    texts = _hashed(docs).where(F.col("doc_id").isNotNull())
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cls")
    named = wanted.join(classes.select("cls", "doc_id", "th"), "cls")
    # only texts that are in a pair move, once for both sides, at every size
    held = materialize(named.hint("merge").join(texts, ["doc_id", "th"]).dropDuplicates(["cls"]).select("cls", "text"), "pair-texts")
    side_b = held.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    side_a = held.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.hint("merge").join(side_b, "b").hint("merge").join(side_a, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i, j, data, offs in pieces(batch, "text_b"):
                others = shingle_sets(data, offs, size)
                for k in range(i, j):
                    if last[0] != a[k]:
                        raw = (batch.column(2)[k].as_py() or "").encode()
                        last = (a[k], shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), size)[0])
                    x, y = last[1], others[k - i]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def _agree(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose signatures agree in ``MATCHES`` coordinates."""
    small = classes.select("cls", "n", F.transform("coords", lambda x: x.bitwiseAND(0x7FFF).cast("smallint")).alias("sig"))
    a = small.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = small.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    sized = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return pairs.join(a, "a").join(b, "b").where(sized & (same >= MATCHES)).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document, by shingles of ``size`` words."""
    texts = narrow(docs)
    base = materialize(signed(docs, size), "signed")
    full = base.where("n_shingles > 0 and doc_id is not null")
    identity = ["s1", "s2", "n_shingles"]
    sets = full.groupBy(*identity).agg(F.min(F.struct("doc_id", "th", "coords")).alias("x")).select(*identity, "x.*")
    # class numbers are in order of the smallest ids, so the smallest class of a component has its smallest id
    numbered = sets.orderBy("doc_id", "th").withColumn("cls", F.monotonically_increasing_id())
    classes = materialize(numbered.select("cls", F.col("n_shingles").alias("n"), "s1", "s2", "doc_id", "th", "coords"), "classes")
    of_id = full.select("doc_id", *identity).distinct().join(classes.select("cls", F.col("n").alias("n_shingles"), "s1", "s2"), identity).select("doc_id", "cls")
    first = of_id.groupBy("doc_id").agg(F.min("cls").alias("cls"), F.max("cls").alias("last"))
    several = of_id.join(first.where("cls <> last").select("doc_id", F.col("cls").alias("a")), "doc_id").select("a", F.col("cls").alias("b"))
    found = components(_links(classes, texts, size).union(several))
    smallest = classes.select("cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"))
    named = smallest.join(classes.select(F.col("cls").alias("component"), F.col("doc_id").alias("component_id")), "component").select("cls", "component_id")
    ids = first.select("doc_id", "cls").join(named, "cls").select("doc_id", "component_id")
    out = base.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _posted(classes: DataFrame) -> DataFrame:
    """The postings of prefixes (cls, j, v) with size and first member of their lists, which hold two classes or more."""
    posted = classes.select("cls", F.posexplode("coords").alias("j", "v"))
    lists = posted.groupBy("j", "v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(posted.join(lists, ["j", "v"]), "shared")
    # lists of one member come first in a prefix; a class has COORDINATES postings at most
    by_length = Window.partitionBy("cls").orderBy("size", "j", "v")
    placed = shared.withColumn("place", F.row_number().over(by_length)).withColumn("alone", COORDINATES - F.count(F.lit(1)).over(Window.partitionBy("cls")))
    prefix = placed.where(F.col("alone") + F.col("place") <= COORDINATES - MATCHES + 1).select("cls", "j", "v")
    kept = prefix.groupBy("j", "v").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("pivot")).where("size > 1")
    return materialize(prefix.join(kept, ["j", "v"]), "lists")


def _links(classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Confirmed links, enough of them for all components."""
    members = _posted(classes)
    short = members.where(F.col("size") <= SHORT)
    x, y = short.select("j", "v", F.col("cls").alias("a")), short.select("j", "v", F.col("cls").alias("b"))
    pairs = x.join(y, ["j", "v"]).where("a < b").select("a", "b")
    stars = members.where((F.col("size") > SHORT) & (F.col("cls") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    links = _compare(pairs.union(stars), classes, texts, size)

    # the long lists, without their first members, that still hold two components
    left = members.where((F.col("size") > SHORT) & (F.col("cls") != F.col("pivot"))).select("j", "v", "cls")
    found = components(links)
    live = _live(left, found)
    if live is None:
        return links
    held = _shingles(live.select("cls").distinct(), classes, texts, size)
    able = _able(classes, held)
    live = _live(left.join(able.select("cls"), "cls", "left_semi"), found)
    if live is None:
        return links
    return materialize(links.union(_between(live, held)), "links")


def _between(live: DataFrame, held: DataFrame) -> DataFrame:
    """Links of members outside the largest component of their family (lists that share members) with the others.

    Members are dealt into parts; two parts are compared in one task, as products of incidence
    matrices, which gives all intersections of full sets at once. Pairs are never written: a task returns
    one edge toward each component for each member.
    """
    least = live.groupBy("j", "v").agg(F.min("cls").alias("b"))
    family = components(live.select("j", "v", F.col("cls").alias("a")).join(least, ["j", "v"]).select("a", "b")).withColumnRenamed("node", "cls").withColumnRenamed("component", "fam")
    placed = live.select("cls", "comp").distinct().join(family, "cls")
    counts = placed.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("fam").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"))
    sets = held.groupBy("cls").agg(F.collect_list("g").alias("g"))  # a set: no more than its document
    part = lambda n: F.ceil(n / PART).cast("int")
    placed = placed.join(counts.select("fam", F.col("top.comp").alias("core"), part(F.col("all")).alias("n_all"), part(F.col("all") - F.col("top.k")).alias("n_out")), "fam").join(sets, "cls")
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = placed.where("comp <> core").withColumn("p", mine("n_out")).withColumn("q", every("n_all")).withColumn("out", F.lit(True))
    others = placed.withColumn("q", mine("n_all")).withColumn("p", every("n_out")).withColumn("out", F.lit(False))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf["out"].to_numpy()
        x, y = pdf[out], pdf[~out]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        linked = _linked([np.asarray(g) for g in x["g"]], [np.asarray(g) for g in y["g"]])
        xs, ys = x["cls"].to_numpy(), y["cls"].to_numpy()
        i, k = np.nonzero(linked)
        low = np.minimum.reduce([xs, np.where(linked, ys[None, :], np.iinfo(np.int64).max).min(axis=1)])
        edges = np.unique(np.stack([np.concatenate([xs, ys[k]]), np.concatenate([low, low[i]])]), axis=1)
        edges = edges[:, edges[0] != edges[1]]
        return pd.DataFrame({"a": edges[0], "b": edges[1]})

    columns = ["fam", "p", "q", "cls", "out", "g"]
    return outside.select(*columns).union(others.select(*columns)).groupBy("fam", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def _linked(x: list[np.ndarray], y: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Which sets of ``x`` are alike enough with which of ``y``, by their full intersections."""

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(g) for g in sets])

    (gx, rx), (gy, ry) = rows(x), rows(y)
    common = np.intersect1d(gx, gy)
    kx, ky = np.isin(gx, common), np.isin(gy, common)
    cx, cy, rx, ry = np.searchsorted(common, gx[kx]), np.searchsorted(common, gy[ky]), rx[kx], ry[ky]
    both = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, len(common), columns):
        left, right = (np.zeros((n, columns), np.float32) for n in (len(x), len(y)))
        for m, c, r in ((left, cx, rx), (right, cy, ry)):
            here = (c >= a) & (c < a + columns)
            m[r[here], c[here] - a] = 1
        both += left @ right.T
    sizes = np.array([len(g) for g in x])[:, None] + np.array([len(g) for g in y])[None, :]
    return (both > 0) & (100 * both >= PERCENT * (sizes - both))


def _shingles(ids: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """cls and g: a row for each shingle of each of these classes."""
    named = materialize(ids.join(classes.select("cls", "doc_id", "th"), "cls"), "live-ids")
    mine = named.hint("merge").join(_hashed(texts).where(F.col("doc_id").isNotNull()), ["doc_id", "th"]).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for a, _, data, offs in pieces(batch):
                sets = shingle_sets(data, offs, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[a : a + len(sets)], [len(x) for x in sets])), pa.array(np.concatenate(sets).view(np.int64))], names=["cls", "g"])

    # rows that repeat an id and a text give its shingles once
    return materialize(mine.mapInArrow(run, "cls long, g long").distinct(), "live-shingles")


def _able(classes: DataFrame, held: DataFrame) -> DataFrame:
    """Those classes of ``held`` that may link with another of them.

    A prefix filter: with the rarest shingles first, a set that begins with more than
    100 - PERCENT in a hundred of its own ones meets no other set and goes, which leaves
    more shingles alone, and so on. Each pass is one partial count of shingles, linear in the sets.
    """
    able = held.select("cls").distinct().join(classes.select("cls", "n"), "cls")
    left = able.count()
    while True:
        single = held.join(able.select("cls"), "cls", "left_semi").groupBy("g").agg(F.min("cls").alias("cls"), F.max("cls").alias("last")).where("cls = last")
        alone = able.join(single.groupBy("cls").agg(F.count(F.lit(1)).alias("alone")), "cls", "left")
        able = materialize(alone.where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= PERCENT * F.col("n")).select("cls", "n"), "able")
        before, left = left, able.count()
        if before - left <= before // 20:  # what few more passes would take away costs less to compare
            return able


def _compare(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    candidates = materialize(_agree(pairs.distinct(), classes), "candidates")
    return materialize(_confirm(candidates, classes, texts, size), "links")


def _live(lists: DataFrame, found: DataFrame) -> DataFrame | None:
    """Members, with their components, of the lists that hold two components or more; None if there are none."""
    placed = lists.join(found.withColumnRenamed("node", "cls").withColumnRenamed("component", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = placed.groupBy("j", "v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("j", "v")
    live = materialize(placed.join(mixed, ["j", "v"]), "live")
    return None if live.isEmpty() else live


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(ws) - {SHINGLE - 2})] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.k >= {PERCENT} * (x.n + y.n - i.k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, doc_id) AS component_id, coalesce(c.component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
