"""Corrupted partners for clean drawings: one Arrow stage for retries, seeds, faults and the look of the result."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.errors import CorruptionError, RowError
from svgloom.functions import corrupt, raster
from svgloom.session import materialize, new_folder, ship, spread
from svgloom.sources import tables


class Acceptance:
    """Whether a corrupted drawing looks different enough from one clean drawing, which is rendered once."""

    def __init__(self, clean: str, renderer: raster.Renderer, least_mse: float, least_share: float) -> None:
        self.clean, self.renderer, self.least_mse, self.least_share = clean, renderer, least_mse, least_share

    @cached_property
    def image(self):
        try:
            return self.renderer.render(self.clean)
        except Exception as e:
            return CorruptionError(f"render diff failed: {e}")

    def __call__(self, other: str) -> tuple[float, float]:
        """The difference, or CorruptionError if it is too small or cannot be told; (0, 0) unseen if nothing is asked."""
        if self.least_mse <= 0 and self.least_share <= 0:
            return 0.0, 0.0
        if isinstance(self.image, CorruptionError):
            raise self.image
        try:
            mse, share = raster.difference(self.image, self.renderer.render(other))
        except Exception as e:
            raise CorruptionError(f"render diff failed: {e}") from e
        if mse < self.least_mse:
            raise CorruptionError(f"render MSE {mse:.6f} < {self.least_mse:.6f}")
        if share < self.least_share:
            raise CorruptionError(f"changed pixel ratio {share:.6f} < {self.least_share:.6f}")
        return mse, share


def attempt(svg: str, row_seed: int, offset: int, types: list[str], level: str, accept: Acceptance) -> tuple | None:
    """The first of eight seeded tries whose result is accepted: corrupted drawing, types, seed and difference."""
    for k in range(config.RETRIES):
        seed = (row_seed * 100 + offset) * 10 + k
        try:
            other, done = corrupt.stacked(svg, corrupt.drawn_types(types, random.Random(seed)), level, seed)
            return (other, done, seed, *accept(other))
        except RowError:
            continue
    return None


def repair_rows(
    rows: DataFrame,
    levels: tuple[str, ...] = config.LEVELS,
    types: list[str] | None = None,
    per_row: int = 1,
    seed: int = config.SEED,
    least_mse: float = config.LEAST_RENDER_MSE,
    least_share: float = config.LEAST_CHANGED_SHARE,
    renderer: raster.Renderer | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """For each clean row, level and number of repeats a corrupted partner; a row that fails eight times gives none.

    Needs row_index (taken before any shuffle), filename and svg. The seed of a row depends on its index
    only, so neither chunks nor partitions change a result. A clean drawing is rendered once for all its tries. ``keep`` names columns that go along.
    """
    ship(rows.sparkSession)
    types = types or [t for t in corrupt.FAULTS if t != corrupt.TRUNCATION]
    draw = renderer or raster.default_renderer()
    carried = [c for c in keep if c not in schemas.REPAIR.names]
    filled = rows.select("row_index", *[c for c in carried if c != "row_index"], F.col("filename").cast("string"), F.col("svg").cast("string"), *[(F.col(c).cast("string") if c in rows.columns else F.lit("")).alias(c) for c in ("text", "caption_style", "dataset")])
    schema = schemas.T.StructType([*schemas.REPAIR.fields, *[filled.schema[c] for c in carried]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                accept = Acceptance(r["svg"], draw, least_mse, least_share)
                for level in levels:
                    for offset in range(per_row):
                        got = attempt(r["svg"], seed + int(r["row_index"]), offset, types, level, accept)
                        if got:
                            other, done, used, mse, share = got
                            out.append((r["filename"], r["svg"], other, "+".join(done), len(done), used, level, mse, share, r["text"], r["caption_style"], r["dataset"], *[r[c] for c in carried]))
            yield pd.DataFrame(out, columns=schema.names)

    return spread(filled.na.fill("", ["filename", "svg", "text", "caption_style", "dataset"]), "row_index").mapInPandas(run, schema)


def truncated_rows(repair: DataFrame, key: str, rows_a_chunk: int, fraction: float = config.TRUNCATED_FRACTION, seed: int = config.SEED) -> DataFrame:
    """Of each chunk's and level's repair rows a share (rounded half to even, one at least) with the tail cut off as well; differences are not measured (-1).

    A chunk holds the rows whose source number ``key`` is in [n * rows_a_chunk, (n + 1) * rows_a_chunk). Its seed is ``seed`` and its
    first number; picks and cuts depend on it and on a row's place among the repair rows of its chunk, in order of ``key``. A chunk and level
    is one group of ``rows_a_chunk`` rows at most.
    """
    ship(repair.sparkSession)
    if not 0 < fraction <= 1:
        return repair.select(*schemas.REPAIR.names).limit(0)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__key", "corruption_seed"], kind="stable").reset_index(drop=True)
        start = seed + int(group["__chunk"][0]) * rows_a_chunk
        picks = sorted(random.Random(start).sample(range(len(group)), k=max(1, round(len(group) * fraction))))
        b = group.loc[picks]
        seeds = [start * 100_000 + k for k in picks]
        cut = [corrupt.FAULTS[corrupt.TRUNCATION](svg, random.Random(s), level) for svg, level, s in zip(b["corrupted_svg"], b["corruption_level"], seeds)]
        b = b.assign(corrupted_svg=cut, corruption_seed=seeds, corruption_type=b["corruption_type"] + "+truncation", corruption_count=b["corruption_count"] + 1, render_mse=-1.0, changed_pixel_ratio=-1.0)
        return b[schemas.REPAIR.names]

    keyed = repair.select(*schemas.REPAIR.names, F.col(key).cast("long").alias("__key"), F.floor(F.col(key) / rows_a_chunk).cast("long").alias("__chunk"))
    return spread(keyed, "corruption_level", "__chunk").groupBy("corruption_level", "__chunk").applyInPandas(run, schemas.REPAIR)


def _chunks_there(spark, folder: str) -> set[int]:
    """Numbers of the chunks that are whole: their writes left the mark of a committed job."""
    if not tables.exists(spark, folder):
        return set()
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "COMMITTED").load(folder).select(F.regexp_extract("path", r"/chunk_(\d+)/COMMITTED$", 1).try_cast("long").alias("n"))
    return {r.n for r in names.collect()}  # one row for each chunk


def build_checkpoints(
    rows: DataFrame, root: str, rows_a_chunk: int = 1000, levels: tuple[str, ...] = config.LEVELS, fraction: float = config.TRUNCATED_FRACTION, seed: int = config.SEED, resume: bool = False, chunks_a_job: int = 64, **options,
) -> int:
    """Repair rows of ``rows`` (numbered by row_index) by chunk and level under ``root/LEVEL/chunk_N`` and their truncated rows under ``root/truncation/LEVEL/chunk_N``; returns how many chunks and levels were made.

    N is the first row number of a chunk. Existing chunks are an error unless ``resume`` is set: then what is whole stays, chunks without truncated rows
    get these from what is stored, and only the others are made. ``fraction`` of 0 makes no truncated rows. A job takes many chunks at once, and a
    chunk counts once its mark is written, so a run that is cut off loses its last job only.
    """
    spark = ship(rows.sparkSession)
    places = {f"{root}/{level}": level for level in levels}
    done = {folder: _chunks_there(spark, folder) for folder in (*places, *[f"{root}/truncation/{level}" for level in levels])}
    numbered = rows.withColumn("__chunk", F.floor(F.col("row_index") / rows_a_chunk) * rows_a_chunk)
    starts = sorted(r[0] for r in numbered.select("__chunk").distinct().collect())  # one row for each chunk
    if not resume and any(n in found for found in done.values() for n in starts):
        raise ValueError(f"checkpoints exist under {root}: resume or choose another place")
    made = 0
    for folder, level in places.items():
        cut_folder = f"{root}/truncation/{level}"
        lacking = [n for n in starts if n not in done[folder]]
        for a in range(0, len(lacking), chunks_a_job):
            some = lacking[a : a + chunks_a_job]
            # the range reaches the scan, which skips what is stored elsewhere in the order of row_index
            near = numbered.where(F.col("row_index").between(some[0], some[-1] + rows_a_chunk - 1) & F.col("__chunk").isin(some))
            part = materialize(repair_rows(near, (level,), seed=seed, keep=("__chunk", "row_index"), **options), "repair-chunks")
            made += len(some)
            _save_chunks(part, some, folder)
            if fraction > 0:
                _save_cut(part, some, cut_folder, rows_a_chunk, fraction, seed)
        stored = [n for n in starts if n in done[folder] and n not in done[cut_folder]] if fraction > 0 else []
        if stored:
            kept = tables.repair_chunks(spark, folder).withColumn("__chunk", F.regexp_extract("path", r"chunk_(\d+)", 1).try_cast("long")).where(F.col("__chunk").isin(stored))
            # the number of a stored row is in its seed
            number = F.floor(F.floor(F.col("corruption_seed") / 10) / 100) - seed
            _save_cut(kept.withColumn("row_index", number), stored, cut_folder, rows_a_chunk, fraction, seed)
    return made


def _save_cut(part: DataFrame, starts: list[int], folder: str, rows_a_chunk: int, fraction: float, seed: int) -> None:
    cut = truncated_rows(part, "row_index", rows_a_chunk, fraction, seed)
    # the chunk of a truncated row is in its seed
    first = F.floor(F.col("corruption_seed") / 100_000) - seed
    _save_chunks(cut.withColumn("__chunk", F.floor(first / rows_a_chunk) * rows_a_chunk), starts, folder)


def _save_chunks(part: DataFrame, starts: list[int], folder: str) -> None:
    """One folder for each chunk, also for those without rows, with a mark behind the rows."""
    spark = part.sparkSession
    names = F.format_string("%08d", F.col("__chunk"))
    staged = new_folder(spark, "staged-chunks")
    spread(part.select(*schemas.REPAIR.names, names.alias("chunk")), "chunk").write.partitionBy("chunk").parquet(staged)
    tables.publish(spark, {f"{staged}/chunk={n:08d}": f"{folder}/chunk_{n:08d}" for n in starts}, "COMMITTED", "whole\n")  # Spark lists no empty files


def read_checkpoints(spark, root: str, levels: tuple[str, ...] = config.LEVELS) -> DataFrame:
    """All rows under ``root`` in the order levels, then their truncated rows, each by chunk: part, part_order and path tell it. No chunks: an empty table."""
    parts = [(level, f"{root}/{level}") for level in levels] + [(f"truncation/{level}", f"{root}/truncation/{level}") for level in levels]
    return combined(*[(name, tables.repair_chunks(spark, folder)) for name, folder in parts]).orderBy("part_order", "path", "corruption_seed")


def combined(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Levels first, then their truncated rows, with the place of each part for whoever needs the order."""
    order = [*config.LEVELS, *[f"truncation/{x}" for x in config.LEVELS]]
    out = None
    for kind, df in parts:
        df = df.withColumn("part", F.lit(kind)).withColumn("part_order", F.lit(order.index(kind)))
        out = df if out is None else out.unionByName(df)
    return out
