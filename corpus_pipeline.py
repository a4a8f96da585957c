"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the
columns of ``documents``; the last gives token ids. ``run`` writes what a stage
keeps as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svgloom.llm import bpe, decontaminate, langid, line_dedup, minhash
from svgloom.llm.common import table
from svgloom.session import materialize

#: Words of a shingle of the near-dedup stage.
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells; those that it rejects (no text, no letter, or too unsure) go."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that stand earlier in the corpus; one of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs)
    left = out.where((F.col("__n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return left.select(*[F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near-duplicates."""
    gone = minhash.near_duplicates(docs, SHINGLE).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and of what they decode to."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The trained language ID and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
