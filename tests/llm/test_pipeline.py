import hashlib

import duckdb
import public_tokenizers
import tiktoken
from test_decontaminate import edits
from test_line_dedup import brute as without_lines

import corpus_pipeline
from svgloom.llm import bpe
from svgloom.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"


def word_sets(text, size):
    ws = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())


def expected(rows, items):
    """The same decisions by plain loops; the language ID keeps every document with a letter here."""
    texts = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    lines = without_lines(texts.items(), 20)
    texts = {i: t for i, t in lines.items() if t.strip() or t == texts[i]}
    sets, up = {i: word_sets(t, 5) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t).split()
    kept = {}
    for i in ids:
        ws = words(texts[i])
        held = set(ws)
        if find(i) == i and not any(it and sum(w in held for w in it) >= len(it) - len(it) // 5 and edits(it, ws) <= len(it) * 20 // 100 for it in map(words, items)):
            kept[i] = texts[i]
    return kept


def test_as_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    want = expected(rows, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and len(want) < len(rows)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, t in want.items():
        ids = library.encode_ordinary(t)
        assert (list(got[i].ids), got[i].n_tokens, got[i].decoded_sha256) == (ids, len(ids), hashlib.sha256(t.encode()).hexdigest())


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.createDataFrame([(1, "a clean document in the english language of some length", "en", "s", 55), (None, "une phrase en français assez longue pour être reconnue", "fr", "s", 54), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.where("text is not null").collect()} == {1, None}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
