"""Fixed table schemas, and how older or partial tables are brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


CAPTIONS = _struct(filename=_S, svg=_S, text=_S, caption_style=_S, dataset=_S)
CHECKPOINT = _struct(row_index=_L, filename=_S, svg=_S, text=_S, caption_style=_S, dataset=_S, keep=_B, error=_S)
REPAIR = _struct(
    filename=_S, svg=_S, corrupted_svg=_S, corruption_type=_S, corruption_count=_L, corruption_seed=_L, corruption_level=_S,
    render_mse=_D, changed_pixel_ratio=_D, text=_S, caption_style=_S, dataset=_S,
)
PACKAGED = _struct(filename=_S, svg=_S, corrupted_svg=_S, corruption_level=_S, render_mse=_D, changed_pixel_ratio=_D, text=_S, caption_style=_S, dataset=_S, is_truncated=_B)
PUBLISHED_BASE = ("filename", "svg", "text", "dataset")
PUBLISHED_REPAIR = ("filename", "svg", "corrupted_svg", "dataset")
RESULTS = _struct(evaluation_index=_L, filename=_S, prediction_has_svg=_B, prediction_is_valid_svg=_B, prediction_rendered=_B, pixel_mse=_D)
EXAMPLE = _struct(output_index=_L, evaluation_index=_L, filename=_S, image_path=_S, svg_path=_S)
GENERATED = _struct(output_index=_L, text=_S, latency_seconds=_D, request_error=_S)
MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The columns of ``schema`` in its order and types; missing ones, and nulls in them, take their default."""
    defaults, out = defaults or {}, []
    for f in schema.fields:
        have = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(have, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else have).alias(f.name))
    return df.select(*out)


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; available: {', '.join(df.columns)}")


def require_splits(present, required=("train", "test", "val")) -> None:
    missing = sorted(set(required) - set(present))
    if missing:
        raise ValueError(f"Dataset is missing required splits: {', '.join(missing)}")
