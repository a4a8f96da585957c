import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from svgloom.llm import token_files as tf
from svgloom.llm.common import tokenizer_path
from svgloom.session import new_folder


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 50_000, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            if n > 50:
                ids[::37] = 2**32 - 1
            assert (tf.unpack_blocks(n, *tf.pack_blocks(ids)) == ids).all()


def test_files_hold_what_the_library_encodes(spark):
    long = "Wörter and  more\tthings it's 42x " * 3000
    texts = [(5, "Hello World  \n\nagain <|endoftext|> x"), (3, None), (4, ""), (9, long), (-2, "ÀÉ á ́b \x1c  q"), (None, "no id"), (5, "Hello World")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, start string")
    folder = new_folder(spark, "t")
    files = tf.write_token_files(docs, folder)
    got = tf.read_token_files(spark, folder, files).collect()
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in texts]
    assert sorted(((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got)) == sorted((i is not None, i or 0, ids) for i, ids in want)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in texts if i is not None)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = new_folder(spark, "t")
    assert tf.read_token_files(spark, folder, tf.write_token_files(docs, folder)).count() == 0


def _random_texts(n, seed):
    rng = random.Random(seed)
    parts = list("aZé ÀİIı.,;:!?'\"\n\t sSßΣςḱ\u0307\u00a0\u3000世1٣-_<|>Kẞﬁÿ÷×\x1c") + ["<|endoftext|>", "'s", "'LL", "ALİ.", "é,", "÷.", "don't", "é.,", "ALİ, VELİ."]
    for _ in range(n):
        if rng.random() < 0.6:
            yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        else:
            yield "".join(chr(rng.choice([rng.randint(1, 0x3FF), rng.randint(0x20, 0x7E), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x2FFFF)])) + rng.choice(["", ".", " ", ","]) for _ in range(rng.randint(0, 12)))


def _ids(encode, texts):
    raw = [t.encode() for t in texts]
    size, ids = encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), 1)
    return [x.tolist()[:-1] for x in np.split(ids, np.cumsum(size)[:-1])]


@pytest.mark.parametrize("remembered", [tf.REMEMBERED_BYTES, 2000])
def test_random_texts_as_the_library(remembered):
    path = tokenizer_path("word_bpe_49k.json")
    encode, library = tf.WordEncoder(path, remembered), Tokenizer.from_file(path)
    assert encode.by_span
    for seed in range(4):
        texts = list(_random_texts(2000, seed))
        assert _ids(encode, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_go_through_the_library_as_a_whole(tmp_path):
    settings = json.load(open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8"))
    settings["normalizer"]["normalizers"] = settings["normalizer"]["normalizers"][:2]  # keeps capitals
    path = tmp_path / "v.json"
    path.write_text(json.dumps(settings), encoding="utf-8")
    encode, library = tf.WordEncoder(str(path)), Tokenizer.from_file(str(path))
    texts = ["Hello World. AND", "", "İ. x"]
    assert not encode.by_span and _ids(encode, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows_of_one_id_have_one_order(spark):
    rows = [(7, f"text {i}") for i in range(60)] + [(None, f"none {i}") for i in range(40)]
    found = []
    for parts in (1, 7):
        folder = new_folder(spark, "t")
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = tf.read_token_files(spark, folder, tf.write_token_files(docs, folder)).collect()
        found.append(sorted((r.start, r.doc_id or -1, tuple(r.ids)) for r in got))
    assert found[0] == found[1]
