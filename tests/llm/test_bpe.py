import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from svgloom.llm import bpe
from svgloom.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "Hello world's  text,\n\n  with gaps \t and\nlines ",
    " leading", "  two", "", " ", "   ", "\n \n x", "a\n \nb", "a \u2003b", "\u3000 \u00a0x \u00a0", "a é b", "q \u1680z", "x \x1c y  z", "naïve Ünïcode — 世界 12345 <|endoftext|>",
    "a" * 700 + "b" * 300 + " " + "ab" * 400, "Zq9" * 60 + "\u0001\u0002" * 50, "word " * 500, "\x00nul \x00",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_as_the_library(library):
    coder = bpe.DuckBpe(PATH, public_tokenizers.PATTERN)
    raw = [t.encode() for t in TEXTS]
    size, ids = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    ends = np.cumsum(size)
    for text, a, b, back, decimals in zip(TEXTS, ends - size, ends, coder.decode(size, ids), coder.decimals(size, ids)):
        assert ids[a:b].tolist() == library.encode_ordinary(text), text
        assert back.decode() == text
        assert decimals.decode() == ",".join(map(str, ids[a:b].tolist()))


def test_random_texts_as_the_library(library):
    rng = random.Random(5)
    parts = list("aZé İ1٣.,;:!?'\"\n\n\t  s世\u3000\u2003\u0085\u00a0\u1680x\x1c-") + ["'s", "'ll", " the", "word", "\r\n", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(5000)]
    raw = [t.encode() for t in texts]
    for coder in (bpe.DuckBpe(PATH, public_tokenizers.PATTERN), bpe.DuckBpe(PATH, public_tokenizers.PATTERN, remembered=1000)):
        for a in range(0, len(texts), 1000):
            size, ids = coder.encode(np.frombuffer(b"".join(raw[a : a + 1000]), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw[a : a + 1000]])]))
            ends = np.cumsum(size)
            for text, i, j in zip(texts[a : a + 1000], ends - size, ends):
                assert ids[i:j].tolist() == library.encode_ordinary(text), text
            assert b"".join(coder.decode(size, ids)) == b"".join(raw[a : a + 1000])
            coder.close()  # as at the end of a task; the next use opens the database again


def test_tables(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (99, None, None), (0, TEXTS[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got.collect()) == sorted((i is not None, i or 0, library.encode_ordinary(t or "")) for i, t, _ in rows)
    back = {r.doc_id: bytes(r.text).decode() for r in bpe.decode(got).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    for r in bpe.round_trip(docs, with_ids=True).collect():
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = library.encode_ordinary(text)
        assert list(r.ids) == ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip(docs.limit(0)).count() == 0
