"""Sources, splits and limits, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SplitSize:
    scan: int
    target: int


@dataclass(frozen=True)
class Source:
    """A raw table: which columns hold drawing, id and text, and how much of each split is read and kept."""

    key: str
    svg_column: str
    splits: dict[str, SplitSize]
    id_column: str | None = None
    text_column: str | None = None
    caption_style: str = "concise"
    check_quality: bool = True
    columns: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(c for c in (self.svg_column, self.id_column, self.text_column) if c))


def _source(key: str, svg: str, ident: str | None, text: str | None, style: str, check: bool, **splits: tuple[int, int]) -> Source:
    return Source(key, svg, {k: SplitSize(*v) for k, v in splits.items()}, ident, text, style, check)


# The known sources.
SOURCES: dict[str, Source] = {
    s.key: s
    for s in (
        _source("starvector_diagrams", "Svg", "Filename", None, "concise", True, train=(182_000, 40_000), test=(474, 474)),
        _source("vfig_shapes", "svg", "filename", None, "concise", True, train=(6_545, 6_545)),
        _source("vfig_diagrams", "svg", "filename", None, "detailed", True, train=(60_000, 60_000)),
        _source("starvector_emoji", "Svg", "Filename", None, "concise", False, train=(8_708, 8_708), test=(668, 668), val=(667, 667)),
        _source("animal_illustrations", "svg", None, "prompt", "source_prompt", False, train=(1_416, 1_416)),
        _source("svgx_core", "svg_code", "uuid", "qwen_caption", "qwen_caption", False, train=(40_000, 40_000)),
    )
}

# Seed, split shares, limits and thresholds.
SEED = 42
SPLIT_SHARES = {"train": 0.80, "test": 0.10, "val": 0.10}
SPLIT_PRIORITY = ("train", "test", "val")
MOST_TOKENS = 12_288
IGNORED_LABEL = -100
LEAST_STRUCTURAL_SHARE = 0.4
MOST_COMPLEX_SHAPES = 50
LEAST_RENDER_MSE = 0.002
LEAST_CHANGED_SHARE = 0.01
CHANGED_CHANNEL = 8  # of 255: the first whole difference over 0.03
RETRIES = 8
LEVELS = ("medium", "hard")
TRUNCATED_FRACTION = 0.1
KEPT_CHECKPOINTS = 3
RETRY_STATUSES = (429, 500, 502, 503, 504)
DEFAULT_CAPTION_STYLE = "concise"

# Patterns of opening tags that need a closing one, and of closing tags.
OPEN_TAG = r"<svg\b(?=[^>]*>)(?![^>]*?/>)"
CLOSE_TAG = r"</svg\s*>"

# Element classes.
BASIC_TAGS = ("rect", "circle", "ellipse")
CONNECTOR_TAGS = ("line", "polyline")
COMPLEX_TAGS = ("path", "polygon")

# Prompts.
SYSTEM_MESSAGE = (
    "You are an expert digital designer. Generate valid SVG markup that satisfies the user's request. "
    "Return only the SVG code, with no Markdown fences, no explanations, and no extra text."
)
GENERATE_REQUEST = "Generate valid SVG markup for this image."
REPAIR_REQUEST = "Repair this corrupted SVG so it matches the image. Return only the corrected SVG markup.\n\n"
LABEL_PROMPTS = {
    "concise": (
        "Describe the image in 3-4 concise sentences. Preserve important visible text exactly when readable, especially labels, "
        "node names, field names, and values. When the image contains metadata boxes or table-like text, include the key visible "
        "entries exactly. Include visual structure and connections, but skip details you are unsure about."
    ),
    "detailed": (
        "Describe the diagram in 5-7 detailed but concise sentences. Preserve all readable text exactly, including node labels, "
        "table names, field names, values, and captions. Describe the main visual structure, important shapes, groups, arrows, "
        "connectors, hierarchy, and layout. Mention colors, line styles, and repeated patterns only when they help identify parts "
        "of the diagram. If the image looks like a technical diagram, explain the apparent relationships or flow between the "
        "visible elements. Skip any detail you are unsure about rather than guessing."
    ),
}


def source(key: str) -> Source:
    if key not in SOURCES:
        raise ValueError(f"unknown source {key}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[key]


def split_size(spec: Source, split: str) -> SplitSize:
    if split not in spec.splits:
        raise ValueError(f"source {spec.key} has no split {split}; it has {', '.join(spec.splits)}")
    return spec.splits[split]


def label_prompt(style: str) -> str:
    if style not in LABEL_PROMPTS:
        raise ValueError(f"Unknown caption style `{style}`. Available styles: {', '.join(sorted(LABEL_PROMPTS))}")
    return LABEL_PROMPTS[style]
