"""Benchmark decontamination by CGK embeddings, bit sampling and exact edit verification.

Texts and items are sequences of words (maximal runs of letters, digits and bytes
above 127; A-Z lower-cased; punctuation separates; in scripts that put no spaces between words
each character is a word, and CJK punctuation separates, too). A document is contaminated by an item of n words if some
stretch of it is within floor(n * EDITS_PERCENT / 100) word edits of the whole item.

The random walk of the CGK embedding goes over the item-sized window at each word of a
text: step j writes the symbol under the walk and moves on by one word if a random
bit of (j, symbol) says so. Windows with few edits then agree in most places of the
output, and places sampled from the output are a locality-sensitive key. Each of ``WALKS``
walks has its own bits and its own sample. Items are embedded from each of their words
on, so that a leak is found by any of its stretches. Walks end after ``STEPS`` places,
which the sample comes from; so one walk serves windows of all item sizes at once.

Walks alone miss leaks of short items. Items under ``PIECED`` words are therefore also cut into
one piece more than edits are allowed: one piece at least stands unchanged in every leak, so
a look-up of pieces misses none. Of the places that it gives those stay whose window
holds as many of the item's words as a leak must.

Colliding windows are confirmed by the exact edit distance of the item to the text
around the window (semi-global, in words).

Items go to the tasks in blocks of bounded size, ``BLOCKS`` of them with each scan of the documents, whose words are
hashed once for all of these; documents are never shuffled. Items under five words allow no edit: their one piece is the
whole item, and the first place of it in a text is told. Items without any word are none. Null or empty text is clean. Null item text is no item. Repeated rows each
get their row, empty tables empty results, other columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_randoms, lower, mix, narrow, pieces, span_hashes, table, words

EDITS_PERCENT = 20
WALKS = 4
STEPS = 12
SAMPLED = 6
#: Items of fewer words are also searched for by their pieces.
PIECED = 64
#: Bounds of a block of items: rows and bytes of text.
BLOCK_ITEMS = 4096
BLOCK_BYTES = 8 << 20
#: Blocks that one scan of the documents looks for.
BLOCKS = 8
#: Places of pieces that one numpy step compares with their items.
PLACES = 1 << 13

_RANDOMS = byte_randoms(91)
_RNG = np.random.default_rng(92)
_WALK = _RNG.integers(1, 2**62, WALKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**62, (WALKS, STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAMPLES = [np.sort(_RNG.choice(STEPS, SAMPLED, replace=False)) for _ in range(WALKS)]
_SEPARATOR = np.zeros(256, np.uint8) + 32
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _SEPARATOR[_a:_b] = np.arange(_a, _b)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (never 0), starts, ends, and the first word of each text."""
    clean = lower(_SEPARATOR[data])
    starts, ends, rows = words(clean, offs)
    return span_hashes(clean, starts, ends, _RANDOMS) | np.uint64(1), starts, ends, rows


# Code points [from, to) of scripts without spaces between words, and of CJK punctuation.
_CHARACTERS = np.array([0x0E00, 0x10A0, 0x1780, 0x1800, 0x1950, 0x1AB0, 0x2E80, 0x3000, 0x3005, 0x3008, 0x3021, 0x3030, 0x3031, 0x303D, 0x3040, 0x30FB, 0x30FC, 0x3130, 0x31A0, 0x3200, 0x3400, 0x4DC0, 0x4E00, 0xA4D0, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1AFF0, 0x1B300, 0x20000, 0x40000])
_PUNCTUATION = np.array([0x3000, 0x3005, 0x3008, 0x3021, 0x3030, 0x3031, 0x303D, 0x3040, 0x30FB, 0x30FC, 0xFE10, 0xFE20, 0xFE30, 0xFE50, 0xFF00, 0xFF10, 0xFF1A, 0xFF21, 0xFF3B, 0xFF41, 0xFF5B, 0xFF66])


def item_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, with each character of a script without spaces as a word."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return word_hashes(data, offs)
    clean = lower(_SEPARATOR[data])
    b = [data.take(lead + k, mode="clip").astype(np.int64) & 63 for k in range(4)]
    long = data[lead] >= 0xF0
    point = np.where(long, (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3], (b[0] & 15) << 12 | b[1] << 6 | b[2])
    blank = np.searchsorted(_PUNCTUATION, point, "right") % 2 == 1
    for k in range(3):
        clean[np.minimum(lead[blank] + k, len(data) - 1)] = 32
    single = np.searchsorted(_CHARACTERS, point, "right") % 2 == 1
    starts, ends, _ = words(clean, offs)
    cut = np.concatenate([lead[single], (lead + 3 + long)[single]])
    cut = cut[cut < len(data)]
    cut = np.unique(np.concatenate([starts, cut[clean[cut] != 32]]))
    ends = np.minimum(ends[np.searchsorted(starts, cut, "right") - 1], np.append(cut[1:], len(data)))
    return span_hashes(clean, cut, ends, _RANDOMS) | np.uint64(1), cut, ends, np.searchsorted(cut, offs)


def padded(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with STEPS blanks after each text, and where each word now stands."""
    n = len(rows) - 1
    at = np.arange(len(h)) + STEPS * np.repeat(np.arange(n), np.diff(rows))
    out = np.zeros(len(h) + STEPS * n + 1, np.uint64)
    out[at] = h
    return out, at


def keys(line: np.ndarray, at: np.ndarray, walk: int, steps: int, sample) -> np.ndarray:
    """The sampled places of the embedding of the window at each position of ``at``, as one number."""
    symbols = mix(line * _WALK[walk])
    where, out = at.astype(np.int64), np.full(len(at), walk + 7 * steps, np.uint64)
    chosen = set(np.asarray(sample).tolist())
    for j in range(steps):
        s = symbols.take(where)
        if j in chosen:
            out += s * _PLACE[walk, j]
        where += (s >> np.uint64(j + 1)).view(np.int64) & 1
    return mix(out)


def piece_keys(symbols: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The words from each position of ``at`` on, ``length`` of them, as one number."""
    out = np.full(len(at), 1000 + length, np.uint64)
    for j in range(length):
        out += symbols.take(at + j) * _PLACE[0, j]
    return mix(out)


class Items:
    """A block of items with the keys of their windows."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        h, _, _, rows = item_words(data, offs)
        self.ids = ids
        self.words = [h[a:b] for a, b in zip(rows[:-1], rows[1:])]
        line, at = padded(h, rows)
        found, self.families = [], []
        size = np.diff(rows)
        self.allowed = size * EDITS_PERCENT // 100
        if (size >= STEPS).any():
            item = np.concatenate([np.full(size[k] - STEPS + 1, k) for k in np.flatnonzero(size >= STEPS)])
            first = np.concatenate([np.arange(size[k] - STEPS + 1) for k in np.flatnonzero(size >= STEPS)])
            for walk in range(WALKS):
                self.families.append((walk, STEPS, _SAMPLES[walk]))
                found.append((keys(line, at[rows[item] + first], walk, STEPS, _SAMPLES[walk]), item, first))
        cuts: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero((size > 0) & (size < PIECED)).tolist():
            n = int(size[k])
            count = n * EDITS_PERCENT // 100 + 1
            for a, b in ((n * c // count, n * (c + 1) // count) for c in range(count)):
                cuts.setdefault(b - a, []).append((k, a))
        self.lengths, symbols = sorted(cuts), mix(line * _WALK[0])
        for length in self.lengths:
            item, first = np.array(cuts[length]).T
            found.append((piece_keys(symbols, at[rows[item] + first], length), item, first))
        if found:
            k, item, first = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(k, kind="stable")
            self.keys, self.item, self.first = k[order], item[order], first[order]
        else:
            self.keys = np.zeros(0, np.uint64)
        bits = max(16, int(len(self.keys)).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        self.hit = np.zeros(1 << bits, bool)
        self.hit[self.keys >> self.shift] = True

    def near(self, h: np.ndarray, rows: np.ndarray, item: np.ndarray, place: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether the window around each place holds as many words of the item as a leak of it must; each edit takes away one at most."""
        out = np.zeros(len(item), bool)
        size = np.array([len(w) for w in self.words])[item]
        for n in np.unique(size).tolist():
            allowed = n * EDITS_PERCENT // 100
            for e in np.array_split(same := np.flatnonzero(size == n), len(same) // PLACES + 1):
                where = (place[e] - allowed)[:, None] + np.arange(n + 2 * allowed)
                inside = (where >= rows[row[e]][:, None]) & (where < rows[row[e] + 1][:, None])
                # hashes of words are odd
                text = np.where(inside, h.take(where, mode="clip"), np.uint64(0))
                numbers, which = np.unique(item[e], return_inverse=True)
                want = np.stack([self.words[i] for i in numbers.tolist()])[which]
                out[e] = sum((text == want[:, j, None]).any(axis=1).astype(np.int64) for j in range(n)) >= n - allowed
        return out

    def leaks(self, data: np.ndarray, offs: np.ndarray, parsed: tuple | None = None) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item number, edits, first byte, end byte) of the items that it holds, the best place of each. ``parsed`` is ``item_words`` of the texts, if it is known."""
        out: list[list] = [[] for _ in range(len(offs) - 1)]
        h, starts, ends, rows = parsed or item_words(data, offs)
        if not len(h) or not len(self.keys):
            return out
        line, at = padded(h, rows)
        symbols, pairs = mix(line * _WALK[0]), []
        for family in (*self.families, *self.lengths):
            pieced = isinstance(family, int)
            k = piece_keys(symbols, at, family) if pieced else keys(line, at, *family)
            p = np.flatnonzero(self.hit[k >> self.shift])
            lo, hi = np.searchsorted(self.keys, k[p], "left"), np.searchsorted(self.keys, k[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # frequent pieces of many items in steps of about so many pairs
            for some in np.array_split(np.arange(len(p)), int(n.sum()) // (1 << 18) + 1) if len(p) else ():
                m = n[some]
                e = np.repeat(lo[some], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                word = np.repeat(p[some], m)
                pair = np.stack([self.item[e], word - self.first[e], word])
                if pieced:
                    pair = pair[:, self.near(h, rows, pair[0], pair[1], np.searchsorted(rows, word, "right") - 1)]
                if pair.shape[1]:
                    pairs.append(pair)
        if not pairs:
            return out
        item, place, word = np.concatenate(pairs, axis=1)
        row = np.searchsorted(rows, word, "right") - 1
        found = np.unique(np.stack([row, item, place], axis=1), axis=0)
        # an item that allows no edit: its first place is as good as any
        again = np.concatenate([[False], (np.diff(found[:, :2], axis=0) == 0).all(axis=1)])
        found = found[~(again & (self.allowed[found[:, 1]] == 0))]
        k = 0
        while k < len(found):
            r, i, first = found[k].tolist()
            last = first
            want = self.words[i]
            allowed = len(want) * EDITS_PERCENT // 100
            while k < len(found) and found[k, 0] == r and found[k, 1] == i and found[k, 2] - last <= 2 * allowed + 1:
                last = int(found[k, 2])
                k += 1
            a, b = max(int(rows[r]), first - allowed), min(int(rows[r + 1]), last + len(want) + allowed)
            near = h[a:b]
            # each edit takes away one word of the item at most
            if (want[:, None] == near[None, :]).any(axis=1).sum() < len(want) - allowed:
                continue
            edits, x, y = nearest(want, near)
            if edits <= allowed:
                hit = (i, edits, int(starts[a + x] - offs[r]), int(ends[a + max(y, x + 1) - 1] - offs[r]))
                same = next((n for n, z in enumerate(out[r]) if z[0] == i), None)
                if same is None:
                    out[r].append(hit)
                elif edits < out[r][same][1]:
                    out[r][same] = hit
        return out


def nearest(want: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between ``want`` and a stretch of ``text``, and that stretch."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for w in want:
        over = cost + 1
        through = np.empty(m + 1, np.int64)
        through[0] = over[0]
        through[1:] = cost[:-1] + (text != w)
        best = np.minimum(over, through)
        begin = np.where(through <= over, np.concatenate([start[:1], start[:-1]]), start)
        # a word of the text that is skipped costs one: the least of best[k] + (j - k)
        low = np.minimum.accumulate(best - steps)
        at = np.maximum.accumulate(np.where(best - steps == low, steps, 0))
        cost, start = low + steps, begin[at]
    j = int(cost.argmin())
    return int(cost[j]), int(start[j]), j


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The items in blocks of bounded size, in order of their ids; the driver holds one partition of them at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def _scans(docs: DataFrame, benchmark: DataFrame) -> Iterator[list]:
    """Broadcasts of the blocks, those of one scan together."""
    blocks = item_blocks(benchmark)
    while sent := [docs.sparkSession.sparkContext.broadcast(pickle.dumps(b)) for b in islice(blocks, BLOCKS)]:
        yield sent


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, first_byte and end_byte (of the UTF-8 text) of each item that a document holds."""
    source, out = narrow(docs), None
    for scan in _scans(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            blocks = [pickle.loads(sent.value) for sent in scan]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, _, data, offs in pieces(batch, most=1 << 18):
                    parsed = item_words(data, offs)
                    rows = [(ids[a + k], items.ids[i], e, x, y) for items in blocks for k, hits in enumerate(items.leaks(data, offs, parsed)) for i, e, x, y in hits]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["doc_id", "item_id", "edits", "first_byte", "end_byte"])

        found = source.mapInArrow(run, "doc_id long, item_id long, edits long, first_byte long, end_byte long")
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long, first_byte long, end_byte long")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no item: a pass of filters, without a shuffle."""
    narrow(docs)
    for scan in _scans(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            blocks = [pickle.loads(sent.value) for sent in scan]
            for batch in batches:
                for a, b, data, offs in pieces(batch, most=1 << 18):
                    parsed = item_words(data, offs)
                    clean = np.ones(b - a, bool)
                    for items in blocks:
                        clean &= [not x for x in items.leaks(data, offs, parsed)]
                    yield batch.slice(a, b - a).filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = leaks(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("edits").alias("least_edits"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    items = F.coalesce("item_ids", F.array().cast("array<long>"))
    return out.select("doc_id", items.alias("item_ids"), F.size(items).cast("long").alias("n_items"), (F.size(items) > 0).alias("contaminated"), "least_edits")
