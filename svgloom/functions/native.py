"""Scalar functions as Spark expressions: all of them stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from svgloom import config

# Patterns.
_TRAILING_SPACE = r"(?U)[\s\x1c-\x1f]+\z"
_NUMBER = r"-?\d+(?:\.\d+)?"
_SVG = r"(?s)(<svg.*?</svg>)"


def source_text(c: Column) -> Column:
    """A source value as text; null becomes the word None, as string conversion of a missing value gives."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def source_filename(key: str, split: Column, row_index: Column, ident: Column | None) -> Column:
    """The id of a row, or a name made of source, split and row number."""
    return source_text(ident) if ident is not None else F.format_string("%s_%s_%06d.svg", F.lit(key), split, row_index)


def path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def chunk_name(number: Column, digits: int = 6) -> Column:
    return F.format_string(f"chunk_%0{digits}d", number)


def in_truncation_folder(relative_path: Column) -> Column:
    """Whether a part of a path, not only its text, is ``truncation``."""
    return F.array_contains(F.split(relative_path, "/"), "truncation")


def closed_svg(svg: Column) -> Column:
    """Markup with the closing tags that it lacks; white space at its end goes only then."""
    missing = F.regexp_count(svg, F.lit(config.OPEN_TAG)) - F.regexp_count(svg, F.lit(config.CLOSE_TAG))
    return F.when(missing > 0, F.concat(F.regexp_replace(svg, _TRAILING_SPACE, ""), F.repeat(F.lit("\n</svg>"), missing))).otherwise(svg)


def extracted_svg(text: Column) -> Column:
    """From the first ``<svg`` to the next ``</svg>``; null if there is none."""
    return F.trim(F.nullif(F.regexp_extract(text, _SVG, 1), F.lit("")))


def digest(svg: Column) -> Column:
    return F.sha2(svg.cast("binary"), 256)


def unit_hash(value: Column, seed: int = config.SEED) -> Column:
    """A number in [0, 1) from seed and value: the first 64 bits of their SHA-256."""
    bits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), value).cast("binary"), 256), 1, 16)
    return F.conv(bits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_of(svg: Column, seed: int = config.SEED) -> Column:
    """train, test or val by content, so that equal drawings are never apart."""
    u = unit_hash(digest(svg), seed)
    train, test = config.SPLIT_SHARES["train"], config.SPLIT_SHARES["test"]
    return F.when(u < train, "train").when(u < train + test, "test").otherwise("val")


def order_hash(key: Column, seed: int = config.SEED) -> Column:
    """A key whose order is a shuffle: the same on every cluster and for every partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def first_number(text: Column, default: float) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, _NUMBER, 0), F.lit("")).try_cast("double"), F.lit(float(default)))


def ratio(part: Column, whole: Column) -> Column:
    """A share; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def fixed(x: Column, digits: int) -> Column:
    """A double with so many decimals, as its exact binary value rounds, half to even: Java's formatter rounds the shortest decimal instead, half up.

    The product with the power of ten is split into a rounded part and its error, so that ties are told exactly.
    """
    scale = 10**digits
    a = F.abs(x.cast("double"))
    p = a * F.lit(float(scale))
    high = a * F.lit(134217729.0) - (a * F.lit(134217729.0) - a)
    error = (high * F.lit(float(scale)) - p) + (a - high) * F.lit(float(scale))
    whole = F.floor(p)
    over = p - whole
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    sign = F.when(x < 0, "-").otherwise("")
    text = F.concat(sign, F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
    return F.when(p < 2.0**52, text).otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def percent(share: Column) -> Column:
    return F.concat(fixed(share * 100, 1), F.lit("%"))


def local_tag(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"([^}]*)$", 1))


def data_url(content: Column, media: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{media};base64,"), F.base64(content))


def retry_seconds(header: Column, message: Column, attempt: Column) -> Column:
    """Seconds to wait: what the header says, else the message in milliseconds or seconds, else exponential, 8 at most."""
    told = F.regexp_extract(message, r"(?i)try again in (\d+(?:\.\d+)?)ms", 1).try_cast("double") / 1000
    seconds = F.regexp_extract(message, r"(?i)try again in (\d+(?:\.\d+)?)s", 1).try_cast("double")
    return F.coalesce(header.try_cast("double"), told, seconds, F.least(F.lit(0.5) * F.pow(F.lit(2.0), attempt), F.lit(8.0)))


def retryable(status: Column) -> Column:
    return status.isin(*config.RETRY_STATUSES)


def joined_types(types: Column) -> Column:
    return F.array_join(types, "+")


def or_default(c: Column, default: Column | str) -> Column:
    """Null or empty text replaced."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def corruption_count(u: Column) -> Column:
    """How many corruptions a draw in [0, 1) stands for."""
    return F.when(u < 0.50, 1).when(u < 0.75, 2).otherwise(3)


def quality_error(basic: Column, connector: Column, complex_: Column) -> Column:
    """Why a drawing is refused, or null: first no geometry, then too few structural shapes, then too many complex ones."""
    structural = basic + connector
    share = ratio(structural, structural + complex_)
    start = "SVG quality filter failed: "
    return (
        F.when(structural + complex_ == 0, F.lit(start + "no geometric elements found."))
        .when(share < config.LEAST_STRUCTURAL_SHARE, F.concat(F.lit(start + "structural primitive ratio "), fixed(share, 2), F.lit(f" < {config.LEAST_STRUCTURAL_SHARE:.2f}.")))
        .when(complex_ > config.MOST_COMPLEX_SHAPES, F.format_string(start + f"complex shape count %d > {config.MOST_COMPLEX_SHAPES}.", complex_))
    )


def pixel_mse(clean: Column, other: Column, scale: float = 255.0) -> Column:
    """Mean squared difference of two equally long arrays of channel values."""
    squares = F.zip_with(clean, other, lambda a, b: F.pow((a - b).cast("double") / scale, 2.0))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(clean)


def changed_share(clean: Column, other: Column, channels: int = 4, least: float = config.CHANGED_CHANNEL) -> Column:
    """Share of pixels (groups of ``channels`` values) with a channel that differs by ``least`` or more."""
    far = F.zip_with(clean, other, lambda a, b: F.abs(a - b) >= least)
    pixels = F.transform(F.sequence(F.lit(0), (F.size(far) / channels).cast("int") - 1), lambda p: F.exists(F.slice(far, p * channels + 1, channels), lambda x: x))
    return F.size(F.filter(pixels, lambda x: x)) / F.size(pixels)


def acceptance_error(mse: Column, share: Column, least_mse: float = config.LEAST_RENDER_MSE, least_share: float = config.LEAST_CHANGED_SHARE) -> Column:
    """Why a corrupted drawing looks too much like the clean one, or null; equality passes, and nothing is asked if both limits are 0."""
    if least_mse <= 0 and least_share <= 0:
        return F.lit(None).cast("string")
    return F.when(mse < least_mse, F.concat(F.lit("render MSE "), fixed(mse, 6), F.lit(f" < {least_mse:.6f}"))).when(share < least_share, F.concat(F.lit("changed pixel ratio "), fixed(share, 6), F.lit(f" < {least_share:.6f}")))


def _message(role: str, *parts: tuple[str, Column]) -> Column:
    content = F.array(*[F.struct(F.lit(kind).alias("type"), text.alias("text")) for kind, text in parts])
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def text_prompt(system: str, text: Column) -> Column:
    return F.array(_message("system", ("text", F.lit(system))), _message("user", ("text", text)))


def image_prompt(system: str, image: Column) -> Column:
    """``image`` is what the message carries of the image, such as its data URL."""
    return F.array(_message("system", ("text", F.lit(system))), _message("user", ("text", F.lit(config.GENERATE_REQUEST)), ("image", image)))


def repair_prompt(system: str, image: Column, corrupted: Column) -> Column:
    return F.array(_message("system", ("text", F.lit(system))), _message("user", ("text", F.concat(F.lit(config.REPAIR_REQUEST), corrupted)), ("image", image)))


def label_prompt(style: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in config.LABEL_PROMPTS.items() for x in kv])
    unknown = F.concat(F.lit("Unknown caption style `"), style, F.lit(f"`. Available styles: {', '.join(sorted(config.LABEL_PROMPTS))}"))
    return F.coalesce(F.try_element_at(known, style), F.raise_error(unknown).cast("string"))


def serialized_prompt(messages: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>\n") -> Column:
    """A plain chat template: each message between marks, then the turn of the assistant, without a thinking part."""
    turns = F.transform(messages, lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), F.array_join(F.transform(m["content"], lambda p: p["text"]), "\n"), F.lit(end)))
    return F.concat(F.array_join(turns, ""), F.lit(f"{begin}assistant\n"))
