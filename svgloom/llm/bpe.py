"""Byte-level BPE by recursive SQL.

Each Python worker holds a DuckDB database with two tables made from the rank file:
``merges`` (every pair of tokens whose bytes together are a token) and ``vocab`` (id,
bytes). A batch's distinct unseen words become token-position rows; a recursive query
joins neighbours with ``merges`` and contracts, in every word and round, the leftmost
pair of minimum rank until no word has a pair. Decoding takes a document's ids, joins them
with ``vocab`` and concatenates their bytes in an ordered aggregation. A worker remembers
words and pieces of text (a word with the space before it, stops, a line feed) with
their ids, within a bound of bytes.

Words longer than ``LONG_WORD`` bytes take the same contraction in a loop of SQL
steps: all occurrences of a word's minimum pair at once where no merge that the result
takes part in has a lower rank (then that equals one by one), and only the leftmost
otherwise, so that the state stays linear in the word (a recursive query keeps every round).

Texts are whole. Null text counts as empty: no ids, the hash of nothing. Null ids and
repeated rows keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SpanMemory, among, byte_randoms, distinct_spans, narrow, pieces, ranges, table, tokenizer_path

#: Bytes above which a word is contracted in the loop.
LONG_WORD = 64
#: Bytes that a worker remembers of pieces of text and their ids.
REMEMBERED_BYTES = 32 << 20
#: Bytes of text that are encoded together.
STEP_BYTES = 1 << 19
#: Words that one recursive query takes.
WORDS_A_QUERY = 10_000
#: Ids that one group of the ordered aggregation holds.
DECODED_IDS = 1 << 15

_RANDOMS = byte_randoms(31)
# ASCII letters, stops, ASCII bytes that are neither control characters nor white space, and lead bytes of UTF-8.
_LETTER = among(*range(65, 91), *range(97, 123))
_STOP = among(*b".,;:!?")
_VISIBLE = among(*range(0x21, 0x7F))
_LEAD = among(*range(0xC3, 0xF5))
#: Fixed value: lead and second byte of all white space above U+00A0 in UTF-8.
_WHITE = [(0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]
#: Fixed value: the pattern for which texts may be cut where ``cuts`` does.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_RECURSION = """
WITH RECURSIVE s AS (
    SELECT w, pos, tok, 0 AS round FROM init
  UNION ALL
    (WITH n AS MATERIALIZED (
        SELECT x.w, x.pos, x.tok, x.round, x.np, (m.made::BIGINT << 24) | x.pos AS key
        FROM (SELECT w, pos, tok, round, CASE WHEN lead(w) OVER o = w THEN lead(tok) OVER o END AS r, lead(pos) OVER o AS np FROM s WINDOW o AS (ORDER BY (w::BIGINT << 24) | pos)) x
        LEFT JOIN merges m ON m.pair = ((x.tok::BIGINT << 32) | x.r)
     ), best AS (
        SELECT w, min(key) AS key, arg_min(np, key) AS gone FROM n WHERE key IS NOT NULL GROUP BY w
     )
     SELECT n.w, n.pos, CASE WHEN n.key = best.key THEN (best.key >> 24)::INTEGER ELSE n.tok END, n.round + 1
     FROM n JOIN best ON n.w = best.w
     WHERE n.pos <> best.gone)
)
SELECT w, tok FROM s JOIN (SELECT w, max(round) AS round FROM s GROUP BY w) USING (w, round) ORDER BY w, pos
"""

_STEP = """
CREATE OR REPLACE TABLE long_next AS
WITH n AS (
    SELECT x.*, m.made FROM (SELECT w, pos, tok, lead(tok) OVER o AS r, lead(pos) OVER o AS np FROM long_words WINDOW o AS (PARTITION BY w ORDER BY pos)) x
    LEFT JOIN merges m ON m.pair = ((x.tok::BIGINT << 32) | x.r)
), best AS (
    SELECT w, min(made) AS made FROM n GROUP BY w
), found AS (
    SELECT n.w, n.pos, n.np, n.made, lag(n.np) OVER (PARTITION BY n.w ORDER BY n.pos) IS DISTINCT FROM n.pos AS opens,
        row_number() OVER (PARTITION BY n.w ORDER BY n.pos) AS k
    FROM n JOIN best ON n.w = best.w AND n.made = best.made
), runs AS (
    SELECT *, sum(opens::INT) OVER (PARTITION BY w ORDER BY pos) AS run FROM found
), taken AS (
    SELECT w, pos, np, made FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS i FROM runs)
    WHERE i % 2 = 1 AND (k = 1 OR made NOT IN (SELECT tok FROM unsafe))
)
SELECT n.w, n.pos, coalesce(t.made, n.tok)::INTEGER AS tok, t.made IS NOT NULL AS changed
FROM n LEFT JOIN taken t ON n.w = t.w AND n.pos = t.pos
WHERE NOT EXISTS (SELECT 1 FROM taken g WHERE g.w = n.w AND g.np = n.pos)
"""

_LONG_ENDED = "SELECT w, tok FROM long_words ORDER BY w, pos"

_DECODE = """
SELECT k, string_agg(raw, '' ORDER BY pos) AS raw FROM coded JOIN vocab USING (id) GROUP BY k ORDER BY k
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of pieces that the pattern never matches across.

    A piece begins with a text, with a space before what is surely not white space, with a stop
    after an ASCII letter, and with a line feed between visible characters and with what follows it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    after = np.append(data[1:], np.uint8(32))
    surely = _VISIBLE[after] | _LEAD[after]
    wide = np.flatnonzero((after >= 0xE1) & (after <= 0xE3))
    second = np.append(data, (np.uint8(0), np.uint8(0)))[wide + 2]
    for lead, follows in _WHITE:
        surely[wide[(after[wide] == lead) & (second == follows)]] = False
    begins = np.zeros(n + 1, bool)
    begins[offs] = True
    surely &= ~begins[1:]
    at = (data == 32) & surely
    at[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    feeds = np.flatnonzero((data[1:] == 10) & _VISIBLE[data[:-1]] & surely[1:]) + 1
    at[feeds] = True
    at[np.minimum(feeds + 1, n - 1)] = True
    return np.flatnonzero(at | begins[:n])


class DuckBpe:
    """Encoder and decoder over one in-process DuckDB database."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED_BYTES) -> None:
        import regex

        self.path = path
        self.split = regex.compile(pattern).findall
        self.cuts_hold = pattern == _PATTERN
        ranks = read_ranks(path)
        self.bytes_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.memory = SpanMemory(np.int32, remembered)
        self.decimals = Decimals(max(ranks.values()) + 1)

    @cached_property
    def con(self):
        """The database with merges and vocabulary, opened when it is first needed."""
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "200MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}"), "preserve_insertion_order": "false"})
        ranks = read_ranks(self.path)
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs = np.array(found, np.int64).reshape(-1, 3)
        con.register("p", pa.table({"pair": (pairs[:, 0] << 32) | pairs[:, 1], "a": pairs[:, 0], "b": pairs[:, 1], "made": pairs[:, 2].astype(np.int32)}))
        con.execute("CREATE TABLE merges AS SELECT pair, made FROM p")
        con.execute("CREATE TABLE unsafe AS SELECT a AS tok FROM p WHERE made < a UNION SELECT b FROM p WHERE made < b")
        # a byte stands as the character of its number, so that texts can be aggregated as strings
        con.register("v", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "raw": [t.decode("latin-1") for t in ranks]}))
        con.execute("CREATE TABLE vocab AS SELECT * FROM v")
        for name in ("p", "v"):
            con.unregister(name)
        return con

    def close(self) -> None:
        """Close the database; the next use opens it again. What is remembered stays."""
        if "con" in self.__dict__:
            self.con.close()
            del self.con

    def _register(self, name: str, t: pa.Table) -> None:
        self.con.register(name, t)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word (none may be empty), and all ids in a row."""
        size, parts = np.zeros(len(words), np.int64), []
        length = np.fromiter(map(len, words), np.int64, len(words))
        short, long = np.flatnonzero(length <= LONG_WORD), np.flatnonzero(length > LONG_WORD)

        def ended(at: np.ndarray, query: str) -> None:
            got = self.con.sql(query).to_arrow_table()
            count = np.bincount(got.column("w").to_numpy(), minlength=len(at))
            size[at] = count
            parts.append((at, count, got.column("tok").to_numpy()))

        for a in range(0, len(short), WORDS_A_QUERY):
            part = short[a : a + WORDS_A_QUERY]
            self._register("init", self._rows([words[i] for i in part.tolist()]))
            ended(part, _RECURSION)
        if len(long):
            self._register("init", self._rows([words[i] for i in long.tolist()]))
            self.con.execute("CREATE OR REPLACE TABLE long_words AS SELECT w, pos, tok FROM init")
            while True:
                self.con.execute(_STEP)
                more = self.con.execute("SELECT bool_or(changed) FROM long_next").fetchone()[0]
                self.con.execute("CREATE OR REPLACE TABLE long_words AS SELECT w, pos, tok FROM long_next")
                if not more:
                    break
            ended(long, _LONG_ENDED)
        ids, begin = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        for at, count, tok in parts:
            ids[ranges(begin[at], count)] = tok
        return size, ids

    def _rows(self, words: list[bytes]) -> pa.Table:
        n = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), n), "pos": pos.astype(np.int32), "tok": self.bytes_ids[data]})

    def decode(self, size: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids: ``size`` ids each, one after the other."""
        # a long list is several groups, one after the other
        groups = np.maximum(1, -(-size // DECODED_IDS))
        ends = np.cumsum(size)
        place = np.arange(len(ids)) - np.repeat(ends - size, size)
        k = np.repeat(np.cumsum(groups) - groups, size) + place // DECODED_IDS
        self._register("coded", pa.table({"k": k.astype(np.int32), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        got = self.con.sql(_DECODE).to_arrow_table()
        out = [b""] * int(groups.sum())
        for i, raw in zip(got.column("k").to_pylist(), got.column("raw").to_pylist()):
            out[i] = raw.encode("latin-1")
        if len(out) == len(size):
            return out
        at = np.cumsum(groups).tolist()
        return [b"".join(out[a:b]) for a, b in zip([0, *at[:-1]], at)]

    def _learn(self, new: list[bytes], h: np.ndarray) -> None:
        """Encode pieces of text and remember them, and the words that they consist of, under their hashes."""
        split = [self.split(p.decode("utf-8", "replace")) for p in new]
        whole = np.fromiter((len(ws) == 1 for ws in split), bool, len(split))
        words = list({w for ws in split for w in ws})
        number = {w: i for i, w in enumerate(words)}
        raw = [w.encode() for w in words]
        size, ids = self.encode_words(raw)
        begin = np.cumsum(size) - size
        flat = np.fromiter((number[w] for ws in split for w in ws), np.int64)
        count = np.fromiter(map(len, split), np.int64, len(split))
        of_piece = np.add.reduceat(np.append(size[flat], 0), np.cumsum(count) - count) if len(count) else size[:0]
        self.memory.add(h, np.where(whole, size[flat[np.cumsum(count) - count]], of_piece), ids[ranges(begin[flat], size[flat])])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text (UTF-8 bytes and offsets), and all ids in a row."""
        self.memory.shrink()
        starts = cuts(data, offs) if self.cuts_hold else offs[:-1][np.diff(offs) > 0]
        codes, h, first = distinct_spans(data, starts, np.append(starts[1:], len(data)), _RANDOMS)
        new = np.flatnonzero(self.memory.find(h) < 0)
        if len(new):
            raw, ends = data.tobytes(), np.append(starts[1:], len(data))
            some = first[new]
            self._learn([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())], h[new])
        count, ids = self.memory.rows(self.memory.find(h)[codes])
        return np.diff(np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, offs)]), ids


class Decimals:
    """Ids as decimals with commas, by a table of all ids."""

    def __init__(self, most: int) -> None:
        text = [b"%d," % i for i in range(most)]
        self.size = np.fromiter(map(len, text), np.int64, most)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(text), np.uint8)

    def __call__(self, size: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        """For each list of ids its decimals, joined by commas."""
        wide = self.size[ids]
        text = self.data[ranges(self.begin[ids], wide)].tobytes()
        ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(size)])].tolist()
        for a, b in zip(ends[:-1], ends[1:]):
            yield text[a : max(a, b - 1)]


_CODERS: dict[tuple, DuckBpe] = {}


@contextmanager
def coder(*settings) -> Iterator[DuckBpe]:
    """This worker's coder. Pieces are remembered between tasks; the database is closed with the task, as it would keep an idle worker's memory from other stages."""
    if settings not in _CODERS:
        _CODERS[settings] = DuckBpe(*settings)
    try:
        yield _CODERS[settings]
    finally:
        _CODERS[settings].close()


def _settings(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern


def _lists(size: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    path, pattern = _settings(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(path, pattern) as bpe:
            for batch in batches:
                for a, b, data, offs in pieces(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(*bpe.encode(data, offs))], names=["doc_id", "ids"])

    return narrow(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text (binary) of rows of doc_id and ids; null ids decode to nothing."""
    path, pattern = _settings(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(path, pattern) as bpe:
            for batch in batches:
                lists = [x or [] for x in batch.column(1).to_pylist()]
                ids = np.fromiter(chain.from_iterable(lists), np.int32)
                raw = bpe.decode(np.fromiter(map(len, lists), np.int64, len(lists)), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every document, decode its ids, and return counts and digests of both, with the ids if asked for: the whole trip within one task, so that no ids are moved."""
    path, pattern = _settings(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(path, pattern) as bpe:
            for batch in batches:
                for a, b, data, offs in pieces(batch, most=STEP_BYTES):
                    size, ids = bpe.encode(data, offs)
                    columns = {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "n_tokens": pa.array(size, pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decimals(size, ids)], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decode(size, ids)], pa.string()),
                    }
                    if with_ids:
                        columns["ids"] = _lists(size, ids)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return narrow(docs).mapInArrow(run, schema)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
