"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svgloom.session import ship

#: Fixed value: bytes of text that one numpy step handles at once.
CHUNK_BYTES = 1 << 19

#: Fixed value: the white space that separates words, as the contracts spell it: 0x20 and 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id as long and the text as string, under fixed names: other columns, whatever their names, stay out of the plan."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (int64, one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(batch: pa.RecordBatch, text_col: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch with about ``most`` bytes of text: first row, end row, bytes, offsets. A longer text is a run by itself."""
    data, offs = views(batch.column(batch.schema.get_field_index(text_col)))
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def byte_randoms(seed: int) -> np.ndarray:
    """256 odd random 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


#: Base of the polynomial hash modulo 2^64 and its inverse.
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, randoms: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal bytes, equal hash, wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(randoms[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the index of the first word of each row (one more than rows)."""
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def among(*values: int) -> np.ndarray:
    """A table of 256 flags that are set for these bytes."""
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


class SpanMemory:
    """Rows of numbers by the 64-bit hash of a byte span, in arrays within a bound of bytes.

    Beyond the bound, what was not asked for since the last clearing goes.
    """

    def __init__(self, kind: type, most_bytes: int) -> None:
        self.kind, self.most = kind, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.values = np.zeros(0, bool), np.zeros(0, self.kind)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.begin, self.size, self.used, self.values))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is unknown. Places hold until the next ``add`` or ``shrink``."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at[self.keys[at] != h] = -1
        self.used[at[at >= 0]] = True
        return at

    def add(self, h: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
        """Rows of distinct unknown hashes; ``values`` holds them one after the other."""
        order = np.argsort(h)
        at = np.searchsorted(self.keys, h[order])
        begin = len(self.values) + np.cumsum(size) - size
        self.keys = np.insert(self.keys, at, h[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.size = np.insert(self.size, at, size[order])
        self.used = np.insert(self.used, at, True)
        self.values = np.concatenate([self.values, values.astype(self.kind, copy=False)])

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and values of the rows at these places, one after the other."""
        size = self.size[at]
        return size, self.values[ranges(self.begin[at], size)]

    def shrink(self) -> None:
        if self.nbytes <= self.most:
            return
        kept = np.flatnonzero(self.used)
        if self.size[kept].sum() * self.values.itemsize + 25 * len(kept) > self.most // 2:
            kept = kept[:0]
        size, values = self.rows(kept)
        self.keys, self.begin, self.size = self.keys[kept], np.cumsum(size) - size, size
        self.used, self.values = np.zeros(len(kept), bool), values


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, randoms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte span, equal for equal bytes, the hash of each number, and a span of each number."""
    import pandas as pd

    codes, found = pd.factorize(span_hashes(data, starts, ends, randoms))
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, np.asarray(found, np.uint64), first


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; SVGLOOM_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("SVGLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
