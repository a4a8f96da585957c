import zlib

from svgloom.llm import langid
from svgloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in langid.op4_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i in got if got[i].held_out]
    right = sum(got[i].lang_pred == truth[i] for i in held)
    print("accuracy", right / len(held), "rejected", sum(r.rejected for r in got.values()))
    assert right >= 0.97 * len(held)
    assert sum(r.rejected for r in got.values()) <= 0.01 * len(got)


def test_edges(spark):
    rows = [(1, "the cat and the dog " * 20, "en", 0.5), (2, "der Hund und die Katze " * 20, "de", 0.1), (3, None, "en", 0.2), (4, "", None, 0.3), (5, "123 ### $$", "en", 0.4), (None, "the dog", "en", None), (1, "the cat and the dog " * 20, "en", 0.5), (6, "ß", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = langid.predict(docs, langid.train(docs)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r.lang_pred for r in out}
    assert by[3] == by[4] == by[5] == "und" and by[1] in ("en", "de") and by[6] != "und"
    assert langid.keep_identified(docs).columns == docs.columns
    empty = docs.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0
