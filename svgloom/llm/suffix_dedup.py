"""Removal of repeated byte strings by column-wise construction of a collection's BWT and common prefixes.

Each byte of a text that a string of ``LENGTH`` bytes covers which also starts earlier
(smaller doc_id, or same document, earlier start) is removed. Strings never cross
documents, and are judged on the input.

Equal strings of LENGTH bytes have equal minimizers (the least hash of their substrings
of ``MINIMIZER`` bytes). So texts are cut into segments: longest runs of string starts with
one minimizer, with the bytes that the strings cover. All strings that can be equal
lie in segments with one key, which is what spreads them over the cluster. Keys that occur
once are dropped (without bytes having been moved), and of equal segments only the
earliest goes on, the others being later copies in whole; equal segments of a task
meet before the shuffle. Where they meet, segments are cut once more by minimizers
of two other hashes; of equal runs again the earliest goes on, and what is then alone with its
keys is left out.

The segments of a task are a collection whose Burrows-Wheeler transform grows by one
symbol of each segment in a round, from the last to the first. BWT and common prefixes lie
in files that a round reads in sequence and writes anew, with the new suffixes where the
ranks of their symbols put them; common prefixes of a new suffix and of its successor are one more
than the least one since the previous occurrence of their symbol. At the end, runs of
common prefixes of LENGTH or more are groups of equal strings, all but the first of which are
later copies.

A key with more than ``HOT`` distinct segments is dealt out further by a hash of each string,
so that no task holds an unbounded collection.

Null text counts as empty. Null doc_id is the smallest id (ids under -2 ** 63 + 2 ** 45 are not told from it). Rows that repeat an id and
a text are one document (both rows stay, with one result); with other texts they are told apart and ordered by
a hash of the text: all its 64 bits where the id is null, ``TEXT_BITS`` of them where ids repeat. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from svgloom.session import materialize

from .common import byte_randoms, mix, narrow, pieces, span_hashes, table

LENGTH = 100
MINIMIZER = 24
#: String starts that a segment may hold.
LONGEST = LENGTH - MINIMIZER + 1
#: Distinct segments with one key above which they are dealt out by string.
HOT = 20_000
#: Segments that are taken up at once, and strings that one collection holds at least, if the task has them; keys are never parted.
COLLECTION = 24_000
STRINGS = 2_000

#: Bits of a text's hash that tell rows of one id apart. With a start, a number of starts and flags they fill one number.
TEXT_BITS = 19

_RANDOMS = byte_randoms(11)
_FLIPS = (np.uint64(0x5BD1E9955BD1E995), np.uint64(0x1B873593CC9E2D51))
_SPAN_RANDOMS = byte_randoms(12)
_FIRST_ID = -(2**63)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the substrings of ``size`` bytes at each place (len(data) - size + 1 of them), from powers of two."""
    p = 0x5851F42D4C957F2D
    level, width, parts = _RANDOMS[data], 1, []
    while width <= size:
        if size & width:
            parts.append((width, level))
        if 2 * width > size:
            break
        f = np.uint64(pow(p, width, 1 << 64))
        level = level[: len(level) - width] + f * level[width:]
        width *= 2
    m = len(data) - size + 1
    out, at = np.zeros(m, np.uint64), 0
    for width, level in reversed(parts):
        out += level[at : at + m] * np.uint64(pow(p, at, 1 << 64))
        at += width
    return mix(out)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` neighbours."""
    done = 1
    n = len(x) - width + 1
    while 2 * done <= width:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    return op(x[:n], x[width - done : width - done + n]) if width > done else x


def pack(text, start, size, again, occurs):
    """Text bits, start, string starts, whether the minimizer occurs again in the segment, and occurrences of the key (0: a later copy; 2: two or more)."""
    return text << 42 | start << 11 | size << 3 | again << 2 | occurs


def _places(p):
    """Start and string starts of a packed number."""
    return (p >> 11) & 0x7FFFFFFF, (p >> 3) & 255


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start in the row, string starts, key, whether the minimizer occurs again in the segment, and hash of the bytes, of each segment."""
    n, w = len(data), LENGTH - MINIMIZER + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64, np.uint64))
    if n < LENGTH:
        return none
    grams = _gram_hashes(data, MINIMIZER)
    low = _sliding(grams, w, np.minimum)
    rows = np.flatnonzero(np.diff(offs) >= LENGTH)
    if not len(rows):
        return none
    valid = np.zeros(len(low) + 1, np.int8)
    np.add.at(valid, offs[rows], 1)
    np.add.at(valid, offs[rows + 1] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    begins = np.ones(len(low), bool)
    begins[1:] = low[1:] != low[:-1]
    begins[offs[rows]] = True
    at = np.flatnonzero(begins & valid)
    stops = np.flatnonzero(valid & np.concatenate([begins[1:] | ~valid[1:], [True]])) + 1
    size = stops - at
    long = size > LONGEST
    if long.any():
        cuts = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(at[long], stops[long])])
        at, stops = np.sort(np.concatenate([at[~long], cuts])), stops
        stops = np.minimum(np.concatenate([at[1:], [n]]), stops[np.searchsorted(stops, at, "right")])
        size = stops - at
    key = low[at]
    # places whose hash is the minimizer of a string around them, and how many of them with its key a segment covers
    top = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    places = np.flatnonzero(grams == top)
    value, number = np.unique(grams[places], return_inverse=True)
    line = np.sort(number * (n + 1) + places)
    base = np.searchsorted(value, key) * (n + 1) + at
    again = (np.searchsorted(line, base + size + w - 1) - np.searchsorted(line, base) > 1).astype(np.int64)
    row = np.searchsorted(offs, at, "right") - 1
    return row, at - offs[row], size, key, again, span_hashes(data, at, stops + LENGTH - 1, _SPAN_RANDOMS)


def _keyed(docs: DataFrame) -> DataFrame:
    h = F.xxhash64("text")
    of_null = F.lit(_FIRST_ID) + h.bitwiseAND((1 << (64 - TEXT_BITS)) - 1)
    return narrow(docs).select(F.coalesce("doc_id", of_null).alias("d"), F.shiftrightunsigned(h, 64 - TEXT_BITS).alias("t"), "doc_id", "text")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key k, hash g of the bytes, document d and packed place p of each segment.

    Of equal segments in a piece of a batch the earliest counts for all; the others
    are later copies, with a key of their own.
    """
    for batch in batches:
        d_all, t_all = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, _, data, offs in pieces(batch, most=1 << 17):
            row, start, size, key, again, g = segments(data, offs)
            if not len(row):
                continue
            d, place = d_all[a + row], t_all[a + row] << 31 | start
            key = key.view(np.int64).copy()
            occurs = np.ones(len(row), np.int64)
            _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
            many = np.flatnonzero(count[inverse] > 1)
            if len(many):
                order = many[np.lexsort((place[many], d[many], key[many], g[many]))]
                new = np.concatenate([[True], (g[order[1:]] != g[order[:-1]]) | (key[order[1:]] != key[order[:-1]])])
                first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                occurs[order] = 2
                later = order[(d[order] != d[first]) | (place[order] != place[first])]
                occurs[later] = 0
                key[later] = mix(d[later].view(np.uint64) * np.uint64(3) + place[later].astype(np.uint64)).view(np.int64)
            p = pack(t_all[a + row], start, size, again, occurs)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, g.view(np.int64), d, p)], names=["k", "g", "d", "p"])


class Collection:
    """BWT and common prefixes of a collection of byte strings, built column by column in files."""

    def __init__(self, strings: list[np.ndarray], folder: str) -> None:
        self.size = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(self.size)
        joined = np.concatenate(strings)
        wide = int(joined.max()) == 255
        self.kind = np.uint16 if wide else np.uint8
        self.text = joined.astype(self.kind) + self.kind(1)  # 0 is the end that stands before each string
        self.folder = folder

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def _write(self, name: str, values: np.ndarray) -> None:
        """A file only grows, so it is written over in place."""
        with open(self._path(name), "r+b") as f:
            f.write(memoryview(values).cast("B"))

    def build(self) -> tuple[np.ndarray, np.ndarray]:
        """BWT and common prefixes (up to 255) of all suffixes in order; the first len(strings) are the empty ones."""
        m = len(self.size)
        newest, strings = np.arange(m), np.arange(m)  # places of the last round's suffixes, and whose they are
        self.text[self.ends - 1].tofile(self._path("bwt"))
        np.zeros(m, np.uint8).tofile(self._path("lcp"))
        counts = np.bincount(self.text[self.ends - 1], minlength=258)  # of each symbol in the BWT
        every = np.arange(m + int(self.ends[-1]), dtype=np.int32)
        spare = np.empty(len(every), np.int32)  # places in the order, written anew each round
        for j in range(1, int(self.size.max()) + 1):
            bwt, lcp = np.fromfile(self._path("bwt"), self.kind), np.fromfile(self._path("lcp"), np.uint8)
            at = spare[: len(bwt)]
            # suffixes that begin with a symbol stand in the order of its occurrences in the BWT
            order = np.argsort(bwt, kind="stable")
            done = int(counts[0])  # strings that are complete
            goes_on = self.size[strings] >= j
            newest, strings = newest[goes_on], strings[goes_on]
            at[order] = every[: len(bwt)]
            rank = at[newest]
            # common prefixes of the new suffixes and of their successors
            beside = np.zeros(len(bwt) + 1, bool)
            beside[rank] = beside[rank + 1] = True
            touched = np.flatnonzero(beside[:-1])[::-1]
            touched = touched[bwt[order[touched]] == bwt[order[touched - 1]]]
            pairs = np.empty(2 * len(touched), np.int64)
            pairs[0::2], pairs[1::2] = order[touched - 1] + 1, order[touched] + 1
            least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[0::2] if len(pairs) else np.zeros(0, np.uint8)
            total = m + len(bwt) - done
            old = np.ones(total, bool)
            place = m + rank - done
            old[place] = False
            out_bwt, out_lcp = np.empty(total, self.kind), np.empty(total, np.uint8)
            out_bwt[old], out_lcp[old] = bwt, lcp
            before = self.ends[strings] - j - 1
            symbols = np.where(self.size[strings] > j, self.text[before], self.kind(0))
            out_bwt[place] = symbols
            counts += np.bincount(symbols, minlength=258)
            out_lcp[place] = 0
            out_lcp[m + touched - done] = np.minimum(least, 254) + 1
            self._write("bwt", out_bwt)
            self._write("lcp", out_lcp)
            newest = place
        return np.fromfile(self._path("bwt"), self.kind), np.fromfile(self._path("lcp"), np.uint8)

    def places(self, bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """String and offset of each suffix in order: every string is walked from its end to its start."""
        m = len(self.size)
        order = np.argsort(bwt, kind="stable")
        step = np.empty(len(bwt), np.int64)
        step[order] = np.arange(len(bwt)) + m - int((bwt == 0).sum())
        string, offset = np.empty(len(bwt), np.int64), np.empty(len(bwt), np.int64)
        at, whose, left = np.arange(m), np.arange(m), self.size.copy()
        while len(at):
            string[at], offset[at] = whose, left
            on = left > 0
            at, whose, left = step[at[on]], whose[on], left[on] - 1
        return string, offset


def later_strings(strings: list[np.ndarray], d: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first string start and number of starts of the runs of strings that occur earlier in the collection."""
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        c = Collection(strings, folder)
        bwt, lcp = c.build()
    string, offset = c.places(bwt)
    joint = lcp >= LENGTH
    member = joint.copy()
    member[:-1] |= joint[1:]
    at = np.flatnonzero(member)
    group = np.cumsum(~joint[at])
    s, o = string[at], offset[at]
    place = start[s] + o
    order = np.lexsort((place, d[s], group))
    s, o, place, group = s[order], o[order], place[order], group[order]
    new = np.concatenate([[True], np.diff(group) != 0]) if len(s) else np.zeros(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(s) else np.zeros(0, np.int64)
    at_first = (d[s] == d[s[lead]]) & (place == place[lead])
    s, o = s[~at_first], o[~at_first]
    order = np.lexsort((o, s))
    s, o = s[order], o[order]
    new = np.concatenate([[True], (np.diff(s) != 0) | (np.diff(o) != 1)]) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return s[at], o[at], np.diff(np.append(at, len(s)))


_CUT_NAMES = ["k", "sub", "d", "p", "bytes"]


def _cut(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that take part, with their keys; those of hot keys string by string."""

    def rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.binary())], names=_CUT_NAMES)

    for batch in batches:
        ids, parts = batch.column(0).to_pylist(), batch.column(4).to_pylist()
        out: list[list] = [[] for _ in _CUT_NAMES]
        for a, _, data, offs in pieces(batch):
            raw = data.tobytes()
            for r in range(len(offs) - 1):
                for x in parts[a + r]:
                    p = x["p"]
                    start, n = _places(p)
                    at = int(offs[r]) + start
                    if x["n"] > hot:
                        span, every = data[at : at + n + LENGTH - 1], np.arange(n)
                        subs = (span_hashes(span, every, every + LENGTH, _SPAN_RANDOMS) % np.uint64(1 + x["n"] * 40 // hot)).tolist()
                        cuts = [i for i in range(n) if i == 0 or subs[i] != subs[i - 1]]
                    else:
                        subs, cuts = [0], [0]
                    for i, j in zip(cuts, [*cuts[1:], n]):
                        for c, v in zip(out, (x["k"], subs[i], ids[a + r], pack(p >> 42, start + i, j - i, (p >> 2) & 1, 1), raw[at + i : at + j + LENGTH - 1])):
                            c.append(v)
            if len(out[0]) > 5000:
                yield rows(out)
                out = [[] for _ in _CUT_NAMES]
        yield rows(out)


def _runs(strings: list[bytes], key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segment, first string start, string starts, key and hash of the bytes of the runs of strings that are alike in the minimizers of two more hashes, too."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    grams = _gram_hashes(data, MINIMIZER)
    w = LENGTH - MINIMIZER + 1
    sketch = np.zeros(len(data) - LENGTH + 1, np.uint64)
    for flip in _FLIPS:
        sketch = mix(sketch ^ _sliding(mix(grams ^ flip), w, np.minimum))
    inside = np.zeros(len(sketch) + 1, np.int64)
    np.add.at(inside, offs[:-1], 1)
    np.add.at(inside, offs[1:] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    begins = np.ones(len(sketch), bool)
    begins[1:] = sketch[1:] != sketch[:-1]
    begins[offs[:-1]] = True
    at = np.flatnonzero(begins & inside)
    stops = np.flatnonzero(inside & np.concatenate([begins[1:] | ~inside[1:], [True]])) + 1
    segment = np.searchsorted(offs, at, "right") - 1
    both = mix(sketch[at] + key[segment].view(np.uint64) * np.uint64(3))
    return segment, at - offs[segment], stops - at, both, span_hashes(data, at, stops + LENGTH - 1, _SPAN_RANDOMS)


def _parts(both: np.ndarray) -> Iterator[np.ndarray]:
    """Rows, which come in the order of their keys, in collections of about STRINGS; a key is never parted."""
    ends = np.flatnonzero(np.append(both[1:] != both[:-1], True)) + 1
    a = 0
    while a < len(both):
        b = int(ends[np.searchsorted(ends, min(len(both), a + STRINGS))])
        yield np.arange(a, b)
        a = b


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later strings (d, p) of the segments of a task, which come in the order of their keys."""
    held: list[tuple] = []

    def ended() -> pa.RecordBatch:
        key, sub, d, p = (np.array([x[i] for x in held], np.int64) for i in range(4))
        segment, first, n, both, g = _runs([x[4] for x in held], key + sub * 7)
        d, text, again = d[segment], p[segment] >> 42, (p[segment] >> 2) & 1 == 1
        place = text << 31 | (_places(p)[0][segment] + first)  # in order, and a string further on is a place further on
        # of equal runs the earliest goes on, the others are later copies in whole
        order = np.lexsort((place, d, g, both))
        new = np.concatenate([[True], (both[order[1:]] != both[order[:-1]]) | (g[order[1:]] != g[order[:-1]])])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = order[(d[order] != d[lead]) | (place[order] != place[lead])]
        out_d, out_p = [d[later]], [pack(text[later], place[later] & 0x7FFFFFFF, n[later], 0, 0)]
        # what is alone with its keys now holds no string of another run
        kept = order[new]
        _, inverse, count = np.unique(both[kept], return_inverse=True, return_counts=True)
        kept = kept[(count[inverse] > 1) | again[kept]]
        for rows in _parts(both[kept]):
            some = kept[rows]
            strings = [np.frombuffer(held[s][4], np.uint8)[i : i + k + LENGTH - 1] for s, i, k in zip(segment[some].tolist(), first[some].tolist(), n[some].tolist())]
            s, o, k = later_strings(strings, d[some], place[some])
            s = some[s]
            out_d.append(d[s])
            out_p.append(pack(text[s], (place[s] + o) & 0x7FFFFFFF, k, 0, 0))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_d, out_p)], names=["d", "p"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if len(held) >= COLLECTION and held[-1][:2] != row[:2]:
                yield ended()
                held.clear()
            held.append(row)
    if held:
        yield ended()


def marked(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text and marks (array of p: start and number of the starts of later strings, null for none) of every document."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = _keyed(docs)
    found = source.select("d", "t", "text").mapInArrow(_scan, "k long, g long, d long, p long").repartition("k")
    occurs = F.col("p").bitwiseAND(3)
    by_key = Window.partitionBy("k")
    ranked = found.withColumn("nth", F.rank().over(Window.partitionBy("k", "g").orderBy("d", F.shiftright("p", 11))))
    ranked = ranked.withColumn("total", F.sum(occurs).over(by_key)).withColumn("n", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_key))
    copy = (occurs == 0) | (F.col("nth") > 1)
    kept = ranked.where(copy | ((F.col("total") >= 2) & (F.col("n") >= 2)) | (F.col("p").bitwiseAND(4) != 0))
    kept = materialize(kept.select(F.when(~copy, F.col("k")).alias("k"), "d", F.shiftright("p", 42).alias("t"), "p", "n"), "segments")

    parts = kept.where("k is not null").groupBy("d", "t").agg(F.collect_set(F.struct("k", "p", "n")).alias("parts"))
    cut = source.join(parts, ["d", "t"]).select("d", "t", "doc_id", "text", "parts").mapInArrow(partial(_cut, hot=hot), "k long, sub long, d long, p long, bytes binary")
    compared = cut.repartition(n, "k", "sub").sortWithinPartitions("k", "sub").mapInArrow(_collect, "d long, p long")
    marks = kept.where("k is null").select("d", "p").union(compared).withColumn("t", F.shiftright("p", 42)).groupBy("d", "t").agg(F.collect_set("p").alias("marks"))
    return source.join(marks, ["d", "t"], "left").select("d", "t", "doc_id", "text", "marks")


def spans(marks: list[int] | None) -> list[tuple[int, int]]:
    """Maximal removed runs (first byte, byte after the last) from marks."""
    if not marks:
        return []
    p = np.sort(np.asarray(marks, np.int64))
    a, n = _places(p)  # one text, so in order of starts
    b = np.maximum.accumulate(a + n + LENGTH - 1)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)].tolist()))


def _kept(body: memoryview, cut: list[tuple[int, int]]) -> Iterator[memoryview]:
    at = 0
    for a, b in cut:
        yield body[at:a]
        at = b
    yield body[at:]


def dedup_bytes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, spans (array of removed runs: first byte, byte after the last) and kept (the bytes that are left) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            marks = batch.column(4).to_pylist()
            for a, b, data, offs in pieces(batch):
                cut = [spans(x) for x in marks[a:b]]
                kept = [b"".join(_kept(memoryview(data[offs[i] : offs[i + 1]]), c)) for i, c in enumerate(cut)]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), pa.array([[{"a": x, "b": y} for x, y in c] for c in cut], kind), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])

    return marked(docs, hot).mapInArrow(run, "doc_id long, spans array<struct<a: long, b: long>>, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(4).to_pylist()
            for a, b, data, offs in pieces(batch):
                cut, digests = [spans(x) for x in marks[a:b]], []
                for i, c in enumerate(cut):
                    h = hashlib.sha256()
                    for part in _kept(memoryview(data[offs[i] : offs[i + 1]]), c):
                        h.update(part)
                    digests.append(h.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(a, b - a), pa.array(np.diff(offs), pa.int64()), pa.array([sum(y - x for x, y in c) for c in cut], pa.int64()), pa.array([len(c) for c in cut], pa.int64()), pa.array(digests)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return marked(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Bytes are pairs of hexadecimal digits here; texts are cut into stretches first, as a place far into a long text is slow to find.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, c, substr(x, 2000 * c + 1, 2000 + 2 * ({LENGTH} - 1)) AS part FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2000 + 1)) AS c FROM d)),
p AS (SELECT doc_id, 1000 * c + j AS i, hash(substr(part, 2 * j + 1, 2 * {LENGTH})) AS h FROM (SELECT doc_id, c, part, unnest(range(0, least(1000, len(part) // 2 - {LENGTH} + 1))) AS j FROM s)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM p) WHERE nth > 1),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, (coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {LENGTH} + 1) > {LENGTH})::INT AS new FROM l)),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM n GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT d.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans FROM d JOIN g USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
