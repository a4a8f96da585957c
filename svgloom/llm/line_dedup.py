"""Repeated line runs, by a suffix array over line ids, in DataFrame operations only.

Every document is a sequence of line ids. A run of lines, from one line on, that holds at least
``MIN_CHARACTERS`` characters other than white space (a line counts one at least) and that also starts earlier (smaller
doc_id, or same document, earlier line) is a later copy: its lines are deleted. The floor keeps single
braces and short words, and is low enough for any sentence.

Suffixes are ranked by prefix doubling: ranks of the first ``d`` lines and those ``d``
lines further on, sorted as pairs over the cluster, rank the first ``2 d`` lines. A pair
that occurs once is discarded: nothing that starts there repeats that far. So are
lines that occur once, before the first round. Equal ranks at depth ``d`` are an interval of
the suffix array whose common prefixes are ``d`` lines or longer; a depth that is no
power of two is the overlap of two such intervals. For each line the depth in question
is the least number of lines with ``MIN_CHARACTERS`` characters, so rounds end there: the
array is not completed, and its common prefixes are not computed. Deleted are the overlapping
later copies of such least runs, as in the SQL. These are the maximal repeated runs but for
lines at an end of theirs with which no least run ends (a short line after a long one stays).

Nothing is sampled or capped, and no key holds a group in one task: counts and first
positions are partial aggregates joined back, which adaptive execution splits where
they are skewed. Only lines that occur twice or more take part in the rounds.

Null text has no lines and stays null. Null doc_id comes first in order. Rows with the
same id and the same text are one document and share its result (both rows stay);
with the same id and other text, they are ordered by a hash of the text. An empty table
gives an empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from svgloom.session import materialize

from .common import table

#: Characters other than white space that a repeated run must hold.
MIN_CHARACTERS = 20
#: Fixed value: white space.
_WHITE = " \t\x0b\x0c\r"

_DOC = ["__id", "__th"]


def _ranked(pairs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Order-preserving ranks of rows that are distinct in ``keys``: a sort over the cluster, then increasing numbers, written so that they stay."""
    return materialize(pairs.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), label)


def line_positions(docs: DataFrame) -> DataFrame:
    """A row for each line: document, index, a 128-bit key of the line, characters."""
    line = F.col("line")
    return docs.select(
        F.col("doc_id").cast("long").alias("__id"),
        F.xxhash64("text").alias("__th"),
        F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("i", "line"),
    ).select("__id", "__th", "i", F.xxhash64(F.lit(1), line).alias("k1"), F.xxhash64(F.lit(2), line).alias("k2"), F.greatest(F.lit(1), F.length(F.translate(line, _WHITE, ""))).alias("nw"))


def repeated_runs(docs: DataFrame, least: int = MIN_CHARACTERS) -> DataFrame:
    """Maximal runs of deleted lines: __id, __th, and the array ``runs`` of (first line, line after the last)."""
    lines = line_positions(docs)
    named = _ranked(lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"), ["k1", "k2"], "line-ids")
    in_doc = Window.partitionBy(*_DOC).orderBy("i")
    in_run = Window.partitionBy(*_DOC, "run").orderBy("i")
    ahead = in_run.rowsBetween(0, least - 1)
    at = (
        lines.join(named, ["k1", "k2"])
        .select(*_DOC, "i", "nw", F.col("rank").alias("r"))
        .dropDuplicates([*_DOC, "i"])
        .withColumn("run", F.col("i") - F.row_number().over(in_doc))
        .withColumn("total", F.sum("nw").over(in_run))
        .withColumn("totals", F.collect_list("total").over(ahead))
    )
    need = F.col("total") - F.col("nw") + least
    first = F.array_position(F.transform("totals", lambda x: x >= need), True)
    at = materialize(at.select(*_DOC, "run", "i", F.when(first > 0, first.cast("int")).alias("t"), "r"), "line-runs")

    depth, found = 1, []
    while True:
        # windows of t lines, depth <= t < 2 * depth: two overlapping prefixes of that depth
        other = F.element_at(F.collect_list(F.struct("r")).over(in_run.rowsBetween(0, depth - 1)), F.col("t") - depth + 1)["r"]
        here = at.where("r is not null") if depth == 1 else at
        windows = here.withColumn("r2", F.when((F.col("t") >= depth) & (F.col("t") < 2 * depth), other)).where("r is not null and r2 is not null")
        found.append(windows.select(*_DOC, "i", "t", "r", "r2"))
        if 2 * depth > least or at.where(F.col("t") >= 2 * depth).isEmpty():
            break
        paired = at.withColumn("r2", F.lead("r", depth).over(in_run))
        pairs = paired.where("r is not null and r2 is not null").groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r", "r2")
        names = _ranked(pairs, ["r", "r2"], f"ranks-{2 * depth}")
        at = materialize(paired.join(names, ["r", "r2"], "left").select(*_DOC, "run", "i", "t", F.col("rank").alias("r")), f"suffixes-{2 * depth}")
        depth *= 2

    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    position = F.struct(*_DOC, "i")
    earliest = everything.groupBy("t", "r", "r2").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table of its own, so that the join below has two plain shuffles, which adaptive execution splits at hot lines
    earliest = materialize(earliest, "earliest")
    later = everything.join(earliest, ["t", "r", "r2"]).where(~position.eqNullSafe(F.col("first"))).select(*_DOC, "i", (F.col("i") + F.col("t")).alias("end"))
    before = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.dropDuplicates([*_DOC, "i", "end"]).withColumn("new", F.when(before >= F.col("i"), 0).otherwise(1)).withColumn("island", F.sum("new").over(in_doc))
    runs = islands.groupBy(*_DOC, "island").agg(F.min("i").alias("a"), F.max("end").alias("b"))
    # a document's runs: no more than its lines
    return runs.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, least: int = MIN_CHARACTERS) -> DataFrame:
    """All columns of ``docs`` with ``text`` without its later copies, and __n_lines, __n_removed, __n_runs."""
    runs = repeated_runs(docs, least).withColumnRenamed("__id", "__rid").withColumnRenamed("__th", "__rth")
    joined = docs.withColumn("__th", F.xxhash64("text")).join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col("__rid")) & (F.col("__th") == F.col("__rth")), "left")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["a"], r["b"] - 1)))
    parted = joined.withColumn("__lines", F.split(F.col("text").cast("string"), "\n", -1)).withColumn("__gone", gone)
    # numbers of lines, less those that go, by a hash set: linear in the lines, however many runs there are
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.array_join(F.transform(left, lambda i: F.col("__lines")[i]), "\n")
    return parted.select(
        *[F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("__n_runs"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("__n_lines")).cast("long").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__n_runs").alias("n_runs"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
w AS (SELECT *, greatest(1, length(translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), ''))) AS nw FROM l),
c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM w),
s AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {MIN_CHARACTERS} - 1 AND b.total >= a.total - a.nw + {MIN_CHARACTERS} GROUP BY ALL),
k AS (SELECT s.*, array_to_string(d.ls[s.i + 1 : s.j + 1], chr(10)) AS body FROM s JOIN d USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth FROM k),
cut AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN f ON l.doc_id = f.doc_id AND f.nth > 1 AND l.i BETWEEN f.i AND f.j),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cut),
r AS (SELECT doc_id, count(DISTINCT run) AS n_runs, count(*) AS n FROM g GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN cut USING (doc_id, i) WHERE cut.i IS NULL GROUP BY l.doc_id)
SELECT documents.doc_id, coalesce(len(d.ls), 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.n_runs, 0)::BIGINT AS n_runs,
    CASE WHEN documents.text IS NULL THEN NULL ELSE sha256(coalesce(t.kept, '')) END AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
