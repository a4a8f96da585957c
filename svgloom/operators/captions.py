"""From raw rows to kept or refused caption rows, and from those to the final table."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.functions import markup, native, raster
from svgloom.operators import sampling
from svgloom.session import materialize, ship


class Captioner(Protocol):
    def caption(self, image: bytes, prompt: str) -> str:
        """A caption of a PNG image, or TextLabelError."""


class OfflineCaptioner:
    """A stand-in that names size and prompt; for tests and dry runs."""

    def caption(self, image: bytes, prompt: str) -> str:
        return f"image of {len(image)} bytes: {prompt.split('.')[0]}"


def source_rows(raw: DataFrame, spec: config.Source, split: str, row_index: str = "row_index") -> DataFrame:
    """row_index, filename, raw svg and source text of a raw table."""
    schemas.require_columns(raw, spec.columns)
    name = native.source_filename(spec.key, F.lit(split), F.col(row_index), F.col(spec.id_column) if spec.id_column else None)
    text = native.source_text(F.col(spec.text_column)) if spec.text_column else F.lit(None).cast("string")
    return raw.select(F.col(row_index).cast("long").alias("row_index"), name.alias("filename"), native.source_text(F.col(spec.svg_column)).alias("svg"), text.alias("text"))


def checked(rows: DataFrame, spec: config.Source) -> DataFrame:
    """Rows with ``clean`` (svg, counts) and ``error``: parse error first, then, where the source asks for it, quality."""
    c = F.col("clean")
    quality = native.quality_error(c["basic"], c["connector"], c["complex"]) if spec.check_quality else F.lit(None).cast("string")
    return rows.withColumn("clean", markup.cleaned(F.col("svg"))).withColumn("error", F.coalesce(c["error"], quality))


def caption_rows(raw: DataFrame, spec: config.Source, split: str, captioner: Captioner | None = None, renderer: raster.Renderer | None = None, row_index: str = "row_index") -> DataFrame:
    """Checkpoint rows. Kept ones have the cleaned drawing and text, refused ones the raw drawing, no text and the reason.

    Without a renderer drawings are not rendered. Sources with texts of their own never reach the
    captioner: the two kinds are separate plans, since ``when`` does not keep a Python function from running.
    """
    ship(raw.sparkSession)
    rows = checked(source_rows(raw, spec, split, row_index), spec)
    if renderer is not None or spec.text_column is None:
        draw, tell = renderer or raster.default_renderer(), (captioner or OfflineCaptioner()) if spec.text_column is None else None
        prompt = config.label_prompt(spec.caption_style) if tell else ""

        @F.pandas_udf("text string, error string")
        def rendered(svg: pd.Series) -> pd.DataFrame:
            from svgloom.errors import RowError

            def one(x):
                if x is None:
                    return None, None
                try:
                    image = draw.render(x)
                    return (tell.caption(raster.png(image), prompt) if tell else None), None
                except RowError as e:
                    return None, str(e)

            return pd.DataFrame([one(x) for x in svg], columns=["text", "error"])

        out = rendered(F.when(F.col("error").isNull(), F.col("clean.svg")))
        rows = rows.withColumn("out", out).withColumn("error", F.coalesce("error", "out.error")).withColumn("text", F.coalesce("text", "out.text"))
    keep = F.col("error").isNull()
    return rows.select(
        "row_index", "filename", F.when(keep, F.col("clean.svg")).otherwise(F.col("svg")).alias("svg"), F.when(keep, F.col("text")).alias("text"),
        F.lit(spec.caption_style).alias("caption_style"), F.lit(spec.key).alias("dataset"), keep.alias("keep"), "error",
    )


def until_target(rows: DataFrame, target: int, by: list[str] | None = None) -> DataFrame:
    """Rows in order of row_index until ``target`` were kept: a row is read if fewer were kept before it."""
    by = tuple(by or ())
    # only kept rows are numbered; the one that fills the target ends the reading
    kept = sampling.numbered_in(rows.where("keep").select(*by, "row_index"), by, "row_index", name="__k")
    last = kept.where(F.col("__k") == target - 1).select(*by, F.col("row_index").alias("__last"))
    joined = rows.join(last, list(by), "left") if by else rows.join(F.broadcast(last), F.lit(True), "left")  # one row at most without groups
    return joined.where(F.col("__last").isNull() | (F.col("row_index") <= F.col("__last"))).drop("__last")


def captioned_until(raw: DataFrame, spec: config.Source, split: str, target: int, rows_a_step: int = 50_000, row_index: str = "row_index", **options) -> DataFrame:
    """Checkpoint rows of a raw table, range by range of row_index, until ``target`` rows are kept: ranges after that are never captioned.

    Each range is written before the next begins; one task's worth of rows a range would starve a cluster, so take many.
    """
    end = raw.agg(F.max(row_index)).first()[0]
    out, kept, start = None, 0, 0
    while kept < target and end is not None and start <= end:
        part = materialize(caption_rows(sampling.row_range(raw, start, start + rows_a_step, index=row_index), spec, split, row_index=row_index, **options), "captions")
        out = part if out is None else out.union(part)
        kept, start = kept + part.where("keep").count(), start + rows_a_step
    return caption_rows(raw.limit(0), spec, split, row_index=row_index, **options) if out is None else until_target(out, target)


def final_rows(checkpoints: DataFrame, target: int | None = None) -> DataFrame:
    """The kept rows as the final table: the first ``target`` by row_index."""
    kept = schemas.conform(checkpoints, schemas.CHECKPOINT, {"caption_style": config.DEFAULT_CAPTION_STYLE}).where("keep")
    if target is not None:
        kept = kept.orderBy("row_index").limit(target)
    return schemas.conform(kept, schemas.CAPTIONS)


def checkpoint_state(checkpoints: DataFrame) -> DataFrame:
    """Chunks, rows and kept rows of what is stored."""
    return checkpoints.agg(F.countDistinct("chunk").alias("chunks"), F.count(F.lit(1)).alias("rows"), F.count_if("keep").alias("kept"))


def not_done(rows: DataFrame, done: DataFrame, key: str = "row_index") -> DataFrame:
    """Rows that a stored run does not hold yet."""
    return rows.join(done.select(key), key, "left_anti")
