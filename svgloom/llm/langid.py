"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's byte 3-grams and 4-grams (ASCII lower-cased, other ASCII than letters as a
blank, n-grams that begin with two blanks left out) are hashed to buckets with an
embedding each; the mean embedding goes through a linear softmax. Embeddings and
weights are trained together by stochastic gradient descent in numpy on a bounded
sample: at most ``ROWS_A_LANGUAGE`` rows, with at most ``MOST_TRAINING_BYTES`` bytes each, of each of the ``MOST_LANGUAGES`` most frequent
labels, and ``MOST_ROWS`` in all, so that the driver holds ``MOST_ROWS * MOST_TRAINING_BYTES`` bytes (400 MB) at the very most. One training row in five is held back to calibrate a temperature and the
score under which a prediction is rejected.

As embedding and weights are linear, a worker gets their product: a score for each
bucket and language. Prediction reads whole texts.

Null text, or text without a letter: ``und``, score 0, rejected. Null ids are never
trained on (and count as not held out); repeated rows each get their row; an empty
table gives an empty result; without any labelled row every prediction is ``und``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, pieces, table

#: Bound of the training sample: rows of each language, languages, and bytes of a text that may be in it.
ROWS_A_LANGUAGE = 900
MOST_LANGUAGES = 200
MOST_ROWS = 20_000
MOST_TRAINING_BYTES = 20_000
#: How many times the rows that are wanted of a language a first cut by hash lets through.
SPARE = 3
DIMENSIONS = 16
BITS = 17
EPOCHS = 4
#: Share of correct calibration rows that rejection may cost, and the highest score at which it may reject.
REJECTED_SHARE = 0.001
HIGHEST_THRESHOLD = 0.5
UNKNOWN = "und"
_ORDERS = (3, 4)
_BUCKETS = 1 << BITS

_MAP = np.full(256, 32, np.uint32)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FACTORS = np.random.default_rng(4).integers(1, 2**31, (len(_ORDERS), max(_ORDERS)), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def buckets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at each byte; ``_BUCKETS`` where there is none."""
    x = _MAP[data]
    for k, n in enumerate(_ORDERS):
        h = np.full(len(x), _BUCKETS, np.uint32)
        m = len(x) - n + 1
        if m > 0:
            v = x[:m] * _FACTORS[k, 0]
            for i in range(1, n):
                v += x[i : i + m] * _FACTORS[k, i]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            h[:m] = v >> np.uint32(32 - BITS)
            h[:m][(x[:m] == 32) & (x[1 : m + 1] == 32)] = _BUCKETS
            for t in range(1, n):
                at = offs[1:] - t
                h[at[at >= offs[:-1]]] = _BUCKETS
        yield h


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # languages x (buckets + 1), float32, the last column 0
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text and whether it has an n-gram."""
        n = len(offs) - 1
        out, count = np.zeros((n, len(self.languages))), np.zeros(n)
        full = np.flatnonzero(offs[1:] > offs[:-1])
        if len(full) and self.languages:
            for h in buckets(data, offs):
                count[full] += np.add.reduceat(h < _BUCKETS, offs[full], dtype=np.int64)
                for k in range(len(self.languages)):
                    out[full, k] += np.add.reduceat(self.scores[k].take(h), offs[full], dtype=np.float64)
        out = out / np.maximum(count, 1)[:, None] + self.bias
        return out, count > 0

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        z, _ = self.logits(data, offs)
        if not self.languages:
            return [UNKNOWN] * (len(offs) - 1), np.zeros(len(offs) - 1)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        names, score = [self.languages[i] for i in best], p[np.arange(len(p)), best]
        ascii_letter = np.zeros(len(names), bool)
        full = np.flatnonzero(offs[1:] > offs[:-1])
        if len(full):
            ascii_letter[full] = np.logical_or.reduceat(_LETTER[data], offs[full])
        for i in np.flatnonzero(~ascii_letter).tolist():
            text = data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")
            if not any(c.isalpha() for c in text):
                names[i], score[i] = UNKNOWN, 0.0
        return names, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], seed: int = 7) -> Model:
    """Train embeddings and softmax on the rows given, and calibrate on every fifth."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, _BUCKETS + 1), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(texts))
    held = order[::5] if len(order) >= 50 else order[:0]
    train = np.setdiff1d(order, held)
    grams = {}
    for i in train.tolist():
        data = np.frombuffer(texts[i], np.uint8)
        offs = np.array([0, len(data)])
        h = np.concatenate(list(buckets(data, offs))) if len(data) else np.zeros(0, np.uint32)
        ids, count = np.unique(h[h < _BUCKETS], return_counts=True)
        if len(ids):
            grams[i] = (ids, (count / count.sum()).astype(np.float32))
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (_BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    embed[-1] = 0
    weight, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    usable = np.array(sorted(grams))
    steps, done = EPOCHS * max(1, len(usable)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(usable).tolist():
            rate = 0.5 * (1 - done / steps)
            done += 1
            ids, share = grams[i]
            mean = share @ embed[ids]
            g = softmax((mean @ weight + bias)[None])[0]
            g[y[i]] -= 1
            back = weight @ g
            weight -= rate * np.outer(mean, g)
            bias -= 0.1 * rate * g
            embed[ids] -= rate * np.minimum(share * len(ids), 5)[:, None] * back
    model = Model(languages, np.ascontiguousarray((embed @ weight).T), bias.astype(np.float64))
    if len(held):
        data, offs = np.frombuffer(b"".join(texts[i] for i in held), np.uint8), np.concatenate([[0], np.cumsum([len(texts[i]) for i in held])])
        z, some = model.logits(data, offs)
        z, target = z[some], y[held][some]
        if len(z):
            grid = np.geomspace(0.05, 20, 60)
            loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), target], 1e-12)).mean() for t in grid]
            model.temperature = float(grid[int(np.argmin(loss))])
            p = softmax(z / model.temperature)
            right = p.max(axis=1)[p.argmax(axis=1) == target]
            if len(right):
                model.threshold = float(min(HIGHEST_THRESHOLD, np.quantile(right, REJECTED_SHARE)))
    return model


def held_out(doc_id):
    """Whether a document is in the quarter that is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, lang_col: str = "lang") -> list[tuple[bytes, str]]:
    """The bounded sample: the first rows of each language by a hash of the id."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    keyed = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.octet_length("text").alias("n")).where(F.col("n") <= MOST_TRAINING_BYTES)
    # one row for each language
    common = keyed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    most = min(ROWS_A_LANGUAGE, MOST_ROWS // max(1, len(common)))
    # a cut by hash first, so that no task sorts all rows of a language
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, SPARE * most / r["count"])) for r in common], "lang string, share double")
    unit = F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    able = keyed.join(F.broadcast(shares), "lang").where((F.col("share") >= 1) | (unit < F.col("share")))
    chosen = able.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= most).select("doc_id", "lang")
    texts = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"), F.col(lang_col).cast("string").alias("lang"))
    # both sides are bounded by the sample's size
    rows = texts.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).where(F.length("raw") <= MOST_TRAINING_BYTES).collect()
    rows = sorted((r.lang, r.doc_id, bytes(r.raw)) for r in rows)
    return [(raw, lang) for lang, _, raw in rows]


def train(docs: DataFrame, lang_col: str = "lang") -> Model:
    sample = training_sample(docs, lang_col)
    return fit([x for x, _ in sample], [y for _, y in sample])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        for batch in batches:
            for a, b, data, offs in pieces(batch, most=1 << 20):
                names, score = m.predict(data, offs)
                rejected = [n == UNKNOWN or s < m.threshold for n, s in zip(names, score)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return narrow(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """The documents, with all their columns, whose language is identified; rejected ones go."""
    model = train(docs, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        m = pickle.loads(sent.value)
        raw = [(t or "").encode("utf-8", "replace") for t in text]
        out = []
        for a in range(0, len(raw), 100):
            part = raw[a : a + 100]
            names, score = m.predict(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64))
            out += [n != UNKNOWN and s >= m.threshold for n, s in zip(names, score)]
        return pd.Series(out, dtype=bool)

    narrow(docs)
    return docs.where(kept(F.col("text").cast("string")))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
