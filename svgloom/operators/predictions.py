"""Generated drawings: calls of a model or provider, their retries, and the comparison with the target."""

from __future__ import annotations

import asyncio
import random
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.errors import RowError, SvgExtractionError, TextLabelError
from svgloom.functions import markup, raster
from svgloom.session import ship


class Generator(Protocol):
    async def generate(self, prompt: str) -> str:
        """The text that a model gives for a prompt."""


class OfflineGenerator:
    """A stand-in: a drawing whose size follows from the prompt."""

    async def generate(self, prompt: str) -> str:
        return f'<svg width="8" height="8"><rect width="{len(prompt) % 8 + 1}" height="4" fill="red"/></svg>'


class RetryingCaptioner:
    """A captioner around another that asks again after a while if a call fails; the last failure is the row's error."""

    def __init__(self, inner, attempts: int = 12, wait=time.sleep, seed: int = config.SEED) -> None:
        self.inner, self.attempts, self.wait, self.rng = inner, attempts, wait, random.Random(seed)

    def caption(self, image: bytes, prompt: str) -> str:
        for k in range(self.attempts):
            try:
                return self.inner.caption(image, prompt)
            except Exception as e:
                status, asked = getattr(e, "status", None), getattr(e, "retry_after", 0.0)
                if status not in config.RETRY_STATUSES or k == self.attempts - 1:
                    raise TextLabelError(f"label request failed: {e}") from e
                self.wait(max(float(asked or 0.0), min(0.5 * 2**k, 8.0)) + self.rng.uniform(0, 0.25))
        raise TextLabelError("label request was never made")


def to_call(examples: DataFrame, completed: DataFrame | None, overwrite: bool = False, key: str = "output_index") -> DataFrame:
    """Examples that have no stored result yet; all of them if results are to be made anew."""
    return examples if overwrite or completed is None else examples.join(completed.select(key), key, "left_anti")


def generated(examples: DataFrame, generator: Generator, at_once: int = 4, key: str = "output_index", prompt: str = "prompt") -> DataFrame:
    """key, text, latency_seconds and request_error of each example: up to ``at_once`` calls of a task are open together, and a failed call is a row."""
    ship(examples.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        async def one(gate: asyncio.Semaphore, text: str) -> tuple:
            async with gate:
                began = time.monotonic()
                try:
                    return await generator.generate(text), time.monotonic() - began, None
                except Exception as e:
                    return None, time.monotonic() - began, f"{type(e).__name__}: {e}"

        async def every(texts: list[str]) -> list[tuple]:
            gate = asyncio.Semaphore(at_once)
            return await asyncio.gather(*[one(gate, t) for t in texts])

        for b in batches:
            out = pd.DataFrame(asyncio.run(every(b[prompt].tolist())), columns=["text", "latency_seconds", "request_error"])
            out.insert(0, key, b[key].to_numpy())
            yield out

    return examples.select(F.col(key).cast("long").alias(key), F.col(prompt).cast("string").alias(prompt)).mapInPandas(run, schemas.T.StructType([schemas.T.StructField(key, schemas.T.LongType()), *schemas.GENERATED.fields[1:]]))


def extract(text: str) -> str:
    start = text.find("<svg")
    end = text.find("</svg>", start)
    if start < 0 or end < 0:
        raise SvgExtractionError("no complete drawing in the text")
    return text[start : end + len("</svg>")].strip()


def evaluated(rows: DataFrame, renderer: raster.Renderer | None = None, target: str = "svg", text: str = "text", key: str = "output_index") -> DataFrame:
    """What came of each prediction: whether it holds a drawing, whether that is valid, whether it renders, images, and the difference to the target if both render."""
    ship(rows.sparkSession)
    draw = renderer or raster.default_renderer()

    def drawn(svg: str) -> tuple:
        try:
            return draw.render(svg), None
        except RowError as e:
            return None, str(e)

    def one(clean: str | None, answer: str | None) -> tuple:
        goal, target_error = drawn(clean or "")
        svg, image, error = None, None, None
        try:
            svg = extract(answer or "")
            image, error = drawn(svg)
        except RowError as e:
            error = str(e)
        mse = raster.difference(goal, image)[0] if goal is not None and image is not None else None
        pictures = [raster.png(x) if x is not None else None for x in (image, goal)]
        return svg, svg is not None, svg is not None and markup.is_svg(svg), image is not None, mse, error, goal is not None, target_error, *pictures

    names = ["prediction_svg", "prediction_has_svg", "prediction_is_valid_svg", "prediction_rendered", "pixel_mse", "prediction_error", "target_rendered", "target_error", "prediction_png", "target_png"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([one(c, t) for c, t in zip(b["clean"], b["answer"])], columns=names)
            out.insert(0, key, b[key].to_numpy())
            yield out

    schema = f"{key} long, prediction_svg string, prediction_has_svg boolean, prediction_is_valid_svg boolean, prediction_rendered boolean, pixel_mse double, prediction_error string, target_rendered boolean, target_error string, prediction_png binary, target_png binary"
    return rows.select(F.col(key).cast("long").alias(key), F.col(target).alias("clean"), F.col(text).alias("answer")).mapInPandas(run, schema)
