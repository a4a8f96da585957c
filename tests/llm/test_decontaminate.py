import random

import numpy as np

from svgloom.llm import decontaminate as dc


def edits(a, b):
    """Least edits between a and a stretch of b, by the plain recurrence."""
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = now
    return min(prev)


def change(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        k = rng.randrange(len(ws))
        kind = rng.random()
        if kind < 0.6:
            ws[k] = f"z{rng.randint(0, 10**6)}"
        elif kind < 0.8:
            ws.insert(k, f"z{rng.randint(0, 10**6)}")
        else:
            del ws[k]
    return ws


def test_recall_and_precision(spark):
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    items = [[word() for _ in range(rng.randint(15, 60))] for _ in range(60)]
    docs, planted = [], 0
    for k in range(400):
        ws = [word() for _ in range(rng.randint(0, 150))]
        if k % 2:
            it = rng.choice(items)
            ws[len(ws) // 2 : len(ws) // 2] = change(rng, it, rng.choice([0, 0, len(it) // 10, len(it) * 18 // 100, len(it) * 20 // 100]))
            planted += 1
        docs.append((k, " ".join(ws).title() + "."))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.leaks(d, b).collect()}
    want = {}
    for i, t in docs:
        ws = t.lower().rstrip(".").split()
        for j, it in enumerate(items):
            e = edits(it, ws)
            if e <= len(it) * 20 // 100:
                want[i, j] = e
    assert got.keys() <= want.keys()
    assert len(got) >= 0.99 * len(want) and len(want) >= 0.8 * planted
    assert all(got[k] == want[k] for k in got)
    clean = {r.doc_id for r in dc.drop_contaminated(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in got}


def held(items, texts):
    """The items that each text holds, without Spark."""
    raw = [t.encode() for t in texts]
    out = dc.Items(list(range(len(items))), items).leaks(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    return [{i: e for i, e, _, _ in hits} for hits in out]


def test_every_length_at_the_allowed_edits():
    rng = random.Random(19)
    word = lambda: f"w{rng.randrange(5000)}"
    for n in [*range(5, 41), 50, 63, 64, 100]:
        items = [[word() for _ in range(n)] for _ in range(20)]
        texts = []
        for it in items:
            ws = list(it)
            for k in rng.sample(range(n), n * 20 // 100):
                ws[k] = "other"
            texts += [[word(), *ws, word()], [word(), *change(rng, it, n * 20 // 100), word()], [word(), *change(rng, it, n * 20 // 100 + 1), word()]]
        want = [{i: e for i, it in enumerate(items) if (e := edits(it, ws)) <= n * 20 // 100} for ws in texts]
        assert held([" ".join(x) for x in items], [" ".join(x) for x in texts]) == want, n


def test_short_items_and_scripts_without_spaces():
    items = ["too short", "Paris", "one two, three four", "", "!!", "東京は日本の首都です。", "เมืองหลวงของประเทศไทย", "水"]
    texts = ["Much TOO-short, too short!", "too very short", "paris in spring", "one two three four", "one two three", "昔から、東京は日本の首都です。人口は多い", "昔から東京は日本のxx首都です", "x", "ประเทศเมืองหลวงของประเทศไทยครับ", "火と水", "parisian", "東京"]
    assert held(items, texts) == [{0: 0}, {}, {1: 0}, {2: 0}, {}, {5: 0}, {5: 1}, {}, {6: 0}, {7: 0}, {}, {}]
    h, a, b, rows = dc.item_words(raw := np.frombuffer("Ab 東京、c한국".encode(), np.uint8), np.array([0, 6, len(raw)]))
    assert [raw[x:y].tobytes().decode() for x, y in zip(a, b)] == ["Ab", "東", "京", "c한국"] and rows.tolist() == [0, 2, 4]


def test_nearest_place():
    t = np.arange(1, 30, dtype=np.uint64)
    assert dc.nearest(t[5:12], t) == (0, 5, 12)
    assert dc.nearest(np.array([6, 7, 99, 8], np.uint64), t) == (1, 5, 8)


def test_edges(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until night falls"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, text, 3), (3, "x " * 50_000 + text, 4), (3, text, 5), (4, "quick brown fox jumps over", 6)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, text), (8, None), (9, ""), (10, "too short"), (11, "Quick, brown fox JUMPS over!")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in dc.leaks(docs, bench).collect())
    assert got == [(0, 7), (0, 11), (3, 7), (3, 7), (3, 11), (3, 11), (4, 11)]
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert dc.leaks(docs.limit(0), bench).count() == 0 and dc.leaks(docs, bench.limit(0)).count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == 6


def test_many_blocks_in_several_scans(spark, monkeypatch):
    rng = random.Random(4)
    items = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 30))) for _ in range(50)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(items)] + [(99, "clean words only")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(tuple(r) for r in dc.leaks(docs, bench).collect())
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(dc, "BLOCKS", 3)
    assert sorted(tuple(r) for r in dc.leaks(docs, bench).collect()) == want and {r[0] for r in want} == set(range(50))
    assert [r.doc_id for r in dc.drop_contaminated(docs, bench).collect()] == [99]
