"""XML work that Spark has no expression for, in one Arrow stage."""

from __future__ import annotations

import codecs
import contextlib
import copy
import functools
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from svgloom import config

NAMESPACE = "http://www.w3.org/2000/svg"
ET.register_namespace("", NAMESPACE)
#: Characters that one drawing may have: a guard of the worker, as are document type declarations, which are refused.
MOST_CHARACTERS = 64 << 20

_QUALIFIED = f"{{{NAMESPACE}}}"
_SPECIAL = re.compile(r'[&<>"\r\n\t]')
_IN_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_IN_VALUE = _IN_TEXT | str.maketrans({'"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})
_OPEN, _CLOSE = re.compile(config.OPEN_TAG), re.compile(config.CLOSE_TAG)
_CLASS = {t: k for k, tags in enumerate((config.BASIC_TAGS, config.CONNECTOR_TAGS, config.COMPLEX_TAGS)) for t in tags}


def parse(svg: str) -> ET.Element:
    if len(svg) > MOST_CHARACTERS:
        raise ET.ParseError("drawing too large")
    if "<!DOCTYPE" in svg or "<!ENTITY" in svg:
        raise ET.ParseError("document type declarations are refused")
    return ET.fromstring(svg)


class Trees:
    """The trees of the drawing parsed last and of the one written last: the tries, faults and pictures of a row share one parse."""

    def __init__(self) -> None:
        self.parsed: tuple[str, ET.Element] | None = None
        self.written: tuple[str, ET.Element] | None = None

    def own(self, svg: str) -> ET.Element:
        """A tree that the caller may change."""
        if self.written and self.written[0] == svg:
            (_, root), self.written = self.written, None
            return root
        if not (self.parsed and self.parsed[0] == svg):
            self.parsed = svg, parse(svg)
        return copy.deepcopy(self.parsed[1])

    def shown(self, svg: str) -> ET.Element:
        """A tree that the caller only reads."""
        for known in (self.written, self.parsed):
            if known and known[0] == svg:
                return known[1]
        return parse(svg)

    def write(self, root: ET.Element) -> str:
        """The markup of a tree, which the caller gives away."""
        out = write(root)
        # a carriage return in a text is read as a new line
        self.written = (out, root) if "\r" not in out and len(out) <= MOST_CHARACTERS else None
        return out


def _written(e: ET.Element, out: list[str], space: str) -> bool:
    """Appends the markup of an element; whether all names in it are plain or of the drawings' namespace."""
    tag = e.tag
    if not isinstance(tag, str):
        return False
    if tag[:1] == "{":
        if not tag.startswith(_QUALIFIED):
            return False
        tag = tag[len(_QUALIFIED) :]
    head = f"<{tag}{space}"
    for k, v in e.items():
        if k[:1] == "{" or not isinstance(v, str):
            return False
        head += f' {k}="{v.translate(_IN_VALUE) if _SPECIAL.search(v) else v}"'
    text, tail = e.text, e.tail
    if text or len(e):
        out.append(head + ">")
        if text:
            out.append(text.translate(_IN_TEXT))
        for child in e:
            if not _written(child, out, ""):
                return False
        out.append(f"</{tag}>")
    else:
        out.append(head + " />")
    if tail:
        out.append(tail.translate(_IN_TEXT))
    return True


def write(root: ET.Element) -> str:
    """The markup that ElementTree gives, written in one pass where no name needs a prefix and the root tells the namespace."""
    out: list[str] = []
    if isinstance(root.tag, str) and root.tag.startswith(_QUALIFIED) and _written(root, out, f' xmlns="{NAMESPACE}"'):
        return "".join(out)
    return ET.tostring(root, encoding="unicode")


#: Of this worker, which has one thread.
TREES = Trees()


@functools.lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def local_name(element: ET.Element) -> str:
    return _local(element.tag) if isinstance(element.tag, str) else ""


def unescaped(svg: str) -> str:
    """The first reading of the text that shows an opening tag: as it is, else with backslash escapes decoded; the text itself if none does."""

    def readings():
        yield svg
        with contextlib.suppress(UnicodeDecodeError):
            yield codecs.decode(svg.encode("utf-8"), "unicode_escape")

    return next((r for r in readings() if "<svg" in r), svg)


def closed(svg: str) -> str:
    lacking = len(_OPEN.findall(svg)) - len(_CLOSE.findall(svg))
    return svg.rstrip() + "\n</svg>" * lacking if lacking > 0 else svg


def clean(svg: str) -> str:
    """Unescaped, closed and parsed; a drawing directly inside another stands for both, with the outer attributes that it lacks."""
    root = parse(closed(unescaped(svg)))
    inner = next((c for c in root if c.tag in (f"{{{NAMESPACE}}}svg", "svg")), None)
    if inner is not None:
        inner.attrib.update({k: v for k, v in root.attrib.items() if k not in inner.attrib})
        root = inner
    return write(root)


def shape_counts(svg: str) -> tuple[int, int, int]:
    """Basic shapes, connectors and complex shapes of a drawing."""
    counts = [0, 0, 0]
    for element in parse(svg).iter():
        k = _CLASS.get(local_name(element))
        if k is not None:
            counts[k] += 1
    return counts[0], counts[1], counts[2]


def is_svg(text: str) -> bool:
    try:
        return local_name(parse(text)) == "svg"
    except ET.ParseError:
        return False


def _or_error(work, x: str | None, failed: tuple) -> tuple:
    try:
        return work(x if x is not None else "")
    except ET.ParseError as e:
        return tuple(f"SVG parse failed: {e}" if v is Exception else v for v in failed)


def counts(svg: Column) -> Column:
    """Struct of ok and three counts; what does not parse has zeros. Null counts as empty text, which does not parse."""

    @F.pandas_udf("ok boolean, basic int, connector int, complex int")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = [_or_error(lambda s: (True, *shape_counts(s)), x, (False, 0, 0, 0)) for x in column]
        return pd.DataFrame(rows, columns=["ok", "basic", "connector", "complex"])

    return run(svg)


def cleaned(svg: Column) -> Column:
    """Struct of the cleaned drawing with its counts, or the parse error: one stage for all cheap checks."""

    def work(s: str) -> tuple:
        out = clean(s)
        return (out, None, *shape_counts(out))

    @F.pandas_udf("svg string, error string, basic int, connector int, complex int")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = [_or_error(work, x, (None, Exception, 0, 0, 0)) for x in column]
        return pd.DataFrame(rows, columns=["svg", "error", "basic", "connector", "complex"])

    return run(svg)


def valid(text: Column) -> Column:
    """Whether a text parses and is a drawing."""

    @F.pandas_udf("boolean")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([x is not None and is_svg(x) for x in column], dtype=bool)

    return run(text)
