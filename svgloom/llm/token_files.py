"""Token-id files in patched frame-of-reference blocks.

``write_token_files`` encodes every text with a vocabulary of the tokenizers library,
appends an end id and writes the ids in ascending document order: one file for each
range of ids, in the shared folder. ``read_token_files`` reads them back.

A file is a row of frames and a footer with their offsets. A frame holds the ids and
lengths of its documents, then the ids in blocks of 128: the block's minimum is
subtracted, the differences are packed at the width that covers ``PERCENTILE`` of
them, and the high bits of the others follow in an exception list. ``starts`` gives
each block's first byte, so that any block can be decoded alone.

Null ids sort first and keep their rows, null text counts as empty (only the end id is
written), repeated rows are all kept; rows of one id stand in the order of a hash of
their text, so that starts are the same in every run. An empty table makes no files and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom.session import new_folder

from .common import SpanMemory, among, byte_randoms, distinct_spans, lower, narrow, pieces, ranges, tokenizer_path, words

BLOCK = 128
#: Share of a block's differences that the packed width must cover.
PERCENTILE = 0.9
#: Ids after which a frame is closed.
FRAME_IDS = 1 << 20
#: Bytes of text whose words are looked up together.
STEP_BYTES = 6 << 20
#: Bytes that a worker remembers of spans of text and their ids.
REMEMBERED_BYTES = 64 << 20
#: Fixed value: stops that may end a word.
_STOPS = ".,;:!?"
_STOP = among(*_STOPS.encode())
_LETTER = among(*range(65, 91), *range(97, 123))
#: Fixed value: how a vocabulary must split words for the cuts to hold.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: the white space that words are cut at.
_CUTS = among(0x20, 0x0A)
_RANDOMS = byte_randoms(71)
_MAGIC = b"PFORIDS1"
_U64 = np.uint64


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ``ids`` (uint32): minima, widths, exception counts, block starts, payload."""
    n = len(ids)
    nb = -(-n // BLOCK)
    v = np.empty(nb * BLOCK, np.uint32)
    v[:n] = ids
    v[n:] = ids[-1] if n else 0
    v = v.reshape(nb, BLOCK)
    low = v.min(axis=1) if nb else np.zeros(0, np.uint32)
    d = v - low[:, None]
    at = int(PERCENTILE * BLOCK)
    width = _bit_length(np.partition(d, at, axis=1)[:, at]) if nb else np.zeros(0, np.int64)
    high = d.astype(_U64) >> width[:, None].astype(_U64)
    row, pos = np.nonzero(high)
    count = np.bincount(row, minlength=nb)
    sizes = 16 * width + 5 * count
    starts = np.concatenate([[0], np.cumsum(sizes)])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width).tolist():
        if w == 0:
            continue
        rows = np.flatnonzero(width == w)
        part = d[rows].astype(_U64) & _U64((1 << w) - 1)
        out = np.zeros((len(rows), 2 * w), _U64)
        for i in range(BLOCK):
            at, shift = divmod(i * w, 64)
            out[:, at] |= part[:, i] << _U64(shift)
            if shift + w > 64:
                out[:, at + 1] |= part[:, i] >> _U64(64 - shift)
        payload[starts[rows][:, None] + np.arange(16 * w)] = out.view(np.uint8)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(count)])[row]
        at = starts[row] + 16 * width[row] + 5 * rank
        payload[at] = pos
        payload[at[:, None] + np.arange(1, 5)] = high[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return low, width.astype(np.uint8), count.astype(np.uint8), starts[:-1].astype(_U64), payload


def unpack_blocks(n: int, low: np.ndarray, width: np.ndarray, count: np.ndarray, starts: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """The inverse of :func:`pack_blocks`."""
    nb = len(low)
    out = np.zeros((nb, BLOCK), _U64)
    starts = starts.astype(np.int64)
    for w in np.unique(width).tolist():
        if w == 0:
            continue
        rows = np.flatnonzero(width == w)
        packed = np.ascontiguousarray(payload[starts[rows][:, None] + np.arange(16 * w)]).view(_U64)
        mask = _U64((1 << w) - 1)
        part = np.empty((len(rows), BLOCK), _U64)
        for i in range(BLOCK):
            at, shift = divmod(i * w, 64)
            x = packed[:, at] >> _U64(shift)
            if shift + w > 64:
                x |= packed[:, at + 1] << _U64(64 - shift)
            part[:, i] = x & mask
        out[rows] = part
    count = count.astype(np.int64)
    row = np.repeat(np.arange(nb), count)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = starts[row] + 16 * width[row].astype(np.int64) + 5 * rank
        pos = payload[at]
        high = np.ascontiguousarray(payload[at[:, None] + np.arange(1, 5)]).view("<u4").reshape(-1).astype(_U64)
        out[row, pos] |= high << width[row].astype(_U64)
    return (out + low[:, None].astype(_U64)).astype(np.uint32).reshape(-1)[:n]


def write_frame(sink, docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
    low, width, count, starts, payload = pack_blocks(ids)
    sink.write(struct.pack("<4Q", len(docs), len(ids), len(low), len(payload)))
    sink.write(np.array([d if d is not None else 0 for d in docs], "<i8").tobytes())
    sink.write(np.array([d is None for d in docs], np.uint8).tobytes())
    for x, kind in ((lengths, "<u8"), (low, "<u4"), (width, "u1"), (count, "u1"), (starts, "<u8"), (payload, "u1")):
        sink.write(np.ascontiguousarray(x, kind).tobytes())


def read_frames(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, token ids) of each frame of an open file."""
    if source.read(8) != _MAGIC:
        raise ValueError("not a token-id file")
    size = source.size()
    source.seek(size - 16)
    frames, = struct.unpack("<Q", source.read(8))
    source.seek(size - 16 - 8 * frames)
    offsets = np.frombuffer(source.read(8 * frames), "<u8").tolist()
    for at in offsets:
        source.seek(at)
        nd, n, nb, np_ = struct.unpack("<4Q", source.read(32))

        def take(kind: str, k: int) -> np.ndarray:
            return np.frombuffer(source.read(np.dtype(kind).itemsize * k), kind)

        docs, null = take("<i8", nd).tolist(), take("u1", nd)
        lengths, low, width, count, starts, payload = take("<u8", nd), take("<u4", nb), take("u1", nb), take("u1", nb), take("<u8", nb), take("u1", np_)
        if null.any():
            docs = [None if z else d for d, z in zip(docs, null)]
        yield docs, lengths.astype(np.int64), unpack_blocks(n, low, width, count, starts, payload)


def _cuts_hold(settings: dict) -> bool:
    """Whether a vocabulary drops white space, splits letters from stops and treats words one by one."""
    steps = (settings.get("normalizer") or {}).get("normalizers", [])
    first = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and first["pattern"].get("Regex") == _PATTERN
        and settings.get("post_processor") is None
        and not any(re.search(rf"\s|[{_STOPS}]", t["content"]) for t in settings.get("added_tokens") or [])
    )


class WordEncoder:
    """Ids of texts.

    The vocabulary drops white space and never merges across it, so a text's ids are
    those of its words (cut at spaces and line feeds only) in a row. Nor does it merge a
    letter with the stops that end a word, and it lower-cases: stops after an ASCII letter or
    one of U+00E0 to U+00FF are spans by themselves, and each distinct span goes through the
    library once. The ids of spans are remembered within a bound of bytes. With a
    vocabulary for which this is not so, whole texts go through the library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_span = _cuts_hold(json.load(f))
        self.memory = SpanMemory(np.uint32, remembered)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))

    @staticmethod
    def _spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text with words of ASCII bytes in lower case, starts and ends of spans, and the first span of each row."""
        starts, ends, _ = words(data, offs, _CUTS)
        plain = lower(data)
        if (data > 127).any():
            high = np.concatenate([[0], np.cumsum(data > 127, dtype=np.int32)])
            whose = np.flatnonzero(high[ends] != high[starts])
            as_is = ranges(starts[whose], ends[whose] - starts[whose])
            plain[as_is] = data[as_is]
        solid = np.maximum.accumulate(np.where(_STOP[data], 0, np.arange(1, len(data) + 1, dtype=np.int32))) if len(data) else np.zeros(0, np.int32)
        core = solid[ends - 1].astype(np.int64)  # the end of what stands before a word's last stops
        parted = np.flatnonzero((core > starts) & (core < ends))
        at = core[parted]
        last, before = data[at - 1], data[at - 2]
        letter = _LETTER[last] | ((before == 0xC3) & (last >= 0xA0) & (last <= 0xBF) & (last != 0xB7))
        at = at[letter]
        starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
        return plain, starts, ends, np.searchsorted(starts, offs)

    def __call__(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, its end id included, and all ids in a row."""
        if self.by_span:
            self.memory.shrink()
            plain, starts, ends, rows = self._spans(data, offs)
            codes, h, first = distinct_spans(plain, starts, ends, _RANDOMS)
            new = np.flatnonzero(self.memory.find(h) < 0)
            if len(new):
                raw, some = plain.tobytes(), first[new]
                self.memory.add(h[new], *self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[some].tolist(), ends[some].tolist())]))
            count, ids = self.memory.rows(self.memory.find(h)[codes])
            lengths = np.diff(np.concatenate([[0], np.cumsum(count)])[rows])
        else:
            raw = data.tobytes()
            lengths, ids = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
        out = np.full(len(ids) + len(lengths), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
        return lengths + 1, out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder: kept between tasks, so that a word is encoded once in a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 1) -> list[tuple[int, str, int, int]]:
    """Encode and write all documents. Returns (range number, file, documents, ids) of each file, in document order.

    Each task writes files of its own under a name that no other attempt uses; the
    rows that it returns name the files of the attempt that counts.
    """
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        fs, base = _open_folder(folder)
        part = TaskContext.get().partitionId()
        sink, offsets, name, total, n_docs = None, [], f"ids-{part:06d}-{uuid.uuid4().hex}", 0, 0
        held_docs: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            nonlocal sink, total, n_docs
            if not held_docs:
                return
            if sink is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{name}")
                sink.write(_MAGIC)
            offsets.append(sink.tell())
            lengths, ids = (np.concatenate(x) for x in zip(*held))
            write_frame(sink, held_docs, lengths, ids)
            total, n_docs = total + len(ids), n_docs + len(held_docs)
            held_docs.clear()
            held.clear()

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, data, offs in pieces(batch, most=STEP_BYTES):
                held.append(encode(data, offs, end_id))
                held_docs += doc_ids[a:b]
                if sum(len(x) for _, x in held) >= FRAME_IDS:
                    flush()
        flush()
        if sink is not None:
            sink.write(np.array(offsets, "<u8").tobytes() + struct.pack("<Q", len(offsets)) + _MAGIC)
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n_docs], "n_ids": [total]})

    # rows of one id, and those without one, are many ranges if they are many rows
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = narrow(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    # one row for each range: as many as partitions, not as documents
    return sorted(tuple(r) for r in ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long").collect())


def read_token_files(spark, folder: str, files: list[tuple[int, str, int, int]], with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array) of every document, decoded from the files."""
    rows, start = [], 0
    for _, name, _, n in files:
        rows.append((name, start))
        start += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_folder(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    for docs, lengths, ids in read_frames(source):
                        raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                        begins = ends - lengths
                        columns = {
                            "doc_id": pa.array(docs, pa.int64()),
                            "start": pa.array(at + begins, pa.int64()),
                            "n_tokens": pa.array(lengths, pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64()),
                        }
                        if with_ids:
                            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1] if len(ends) else 0), pa.int32()), pa.array(ids.view(np.int32), pa.int32()))
                        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                        at += len(ids)

    index = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return index.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    from .common import table

    folder = new_folder(spark, "token-files")
    files = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, files, with_ids=False)
