"""A small renderer and the comparison of images.

``NumpyRenderer`` draws rectangles, circles, ellipses, lines, polylines, polygons and paths of
straight and curved commands in plain colours, and text as one box for each word where the word would stand. What it cannot draw raises, so that a drawing is
refused rather than left blank. ``default_renderer`` takes cairosvg where that is installed.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from typing import Protocol

import numpy as np

from svgloom import config
from svgloom.errors import SvgQualityError
from svgloom.functions import markup

# Colour names.
_NAMES = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "lime": (0, 255, 0), "blue": (0, 0, 255),
    "yellow": (255, 255, 0), "orange": (255, 165, 0), "purple": (128, 0, 128), "gray": (128, 128, 128), "grey": (128, 128, 128),
    "silver": (192, 192, 192), "navy": (0, 0, 128), "teal": (0, 128, 128), "maroon": (128, 0, 0), "olive": (128, 128, 0), "aqua": (0, 255, 255), "fuchsia": (255, 0, 255),
}
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_COMMAND = re.compile(r"([MmLlHhVvCcSsQqTtAaZz])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "Z": 0}
_INHERITED = ("fill", "stroke", "stroke-width", "font-size", "text-anchor", "opacity")
_SILENT = ("defs", "metadata", "title", "desc", "style", "symbol", "clippath", "mask", "marker", "lineargradient", "radialgradient", "filter", "pattern")
#: The shapes, and their attributes that say where they are.
_GEOMETRY = {
    "rect": ("x", "y", "width", "height"), "circle": ("cx", "cy", "r"), "ellipse": ("cx", "cy", "rx", "ry"), "line": ("x1", "y1", "x2", "y2"),
    "polyline": ("points",), "polygon": ("points",), "path": ("d",),
}
#: Bytes of masks that a renderer remembers.
_MOST_HELD = 16 << 20
#: Of the font size: width of a character, height of a word's box.
_CHARACTER, _HEIGHT = 0.55, 0.7


class Renderer(Protocol):
    def render(self, svg: str) -> np.ndarray:
        """RGBA pixels (height, width, 4) of a drawing, or SvgQualityError."""


def colour(value: str | None) -> tuple[int, int, int] | None:
    v = (value or "").strip().lower()
    if v in ("", "none", "transparent"):
        return None
    if v in _NAMES:
        return _NAMES[v]
    if v == "currentcolor":
        return 0, 0, 0
    if m := re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})", v):
        h = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
        return int(h[:2], 16), int(h[2:4], 16), int(h[4:], 16)
    if m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", v):
        return tuple(min(255, int(x)) for x in m.groups())
    raise SvgQualityError(f"SVG render failed: colour {value}")


def _length(value: str | None, default: float) -> float:
    m = _NUMBER.match((value or "").strip())
    return float(m[0]) if m else default


def _declared(style: str | None) -> dict[str, str]:
    """The properties of a style attribute that the renderer knows; they count over attributes."""
    pairs = (p.split(":", 1) for p in (style or "").split(";") if ":" in p)
    return {k: v for k, v in ((a.strip().lower(), b.strip()) for a, b in pairs) if k in _INHERITED}


def path_points(d: str, steps: int = 12) -> list[tuple[np.ndarray, bool]]:
    """The flattened subpaths of path data and whether they are closed."""
    out: list[tuple[np.ndarray, bool]] = []
    points: list[tuple[float, float]] = []
    at = start = handle = (0.0, 0.0)
    tokens = [(m[1], m[2]) for m in _COMMAND.finditer(d)]
    k, command, last = 0, "", ""

    def done(closed: bool) -> None:
        if len(points) > 1:
            out.append((np.array(points), closed))
        points.clear()

    while k < len(tokens):
        if tokens[k][0]:
            command = tokens[k][0]
            k += 1
        kind = command.upper()
        if kind not in _ARITY:
            raise SvgQualityError(f"SVG render failed: path command {command or d[:10]!r}")
        n = _ARITY[kind]
        if k + n > len(tokens) or any(tokens[k + i][0] for i in range(n)):
            break
        v = [float(tokens[k + i][1]) for i in range(n)]
        k += n
        dx, dy = at if command.islower() else (0.0, 0.0)
        if kind == "Z":
            done(True)
            at = start
            points.append(at)
            if k < len(tokens) and not tokens[k][0]:
                break
        elif kind == "M":
            done(False)
            at = start = (v[0] + dx, v[1] + dy)
            points.append(at)
            command = "l" if command == "m" else "L"
        elif kind in "LHV":
            at = (v[0] + dx, v[1] + dy) if kind == "L" else (v[0] + dx, at[1]) if kind == "H" else (at[0], v[0] + dy)
            points.append(at)
        else:
            xy = [(v[i] + dx, v[i + 1] + dy) for i in range(0, n, 2)]
            mirrored = (2 * at[0] - handle[0], 2 * at[1] - handle[1])
            if kind == "S":
                xy.insert(0, mirrored if last in "CS" else at)
            elif kind == "T":
                xy.insert(0, mirrored if last in "QT" else at)
            handle = xy[-2]
            control = np.array([at, *xy])
            t = np.linspace(0, 1, steps + 1)[1:, None]
            while len(control) > 1 and control.ndim == 2:
                control = control[:, None, :]
            while len(control) > 1:
                control = control[:-1] * (1 - t) + control[1:] * t
            points += [tuple(p) for p in control[0]]
            at = xy[-1]
        last = kind
    done(False)
    return out


class NumpyRenderer:
    """Each pixel takes the colour at its centre; later shapes cover earlier ones.

    The pixels that a shape covers are remembered: a corrupted drawing shares most shapes with its clean one. Pixels are bytes until something blends.
    """

    def __init__(self, longest: int = 512) -> None:
        self.longest = longest
        self.canvas: tuple | None = None
        self.masks: dict[tuple, list] = {}
        self.held = 0

    def render(self, svg: str) -> np.ndarray:
        try:
            root = markup.TREES.shown(svg)
        except markup.ET.ParseError as e:
            raise SvgQualityError(f"SVG parse failed: {e}") from e
        box = [float(x) for x in _NUMBER.findall(root.get("viewBox", ""))]
        w, h = _length(root.get("width"), box[2] if len(box) == 4 else 100.0), _length(root.get("height"), box[3] if len(box) == 4 else 100.0)
        if not (w > 0 and h > 0):
            raise SvgQualityError("SVG render failed: no size")
        fit = min(1.0, self.longest / max(w, h))
        cols, rows = max(1, round(w * fit)), max(1, round(h * fit))
        x0, y0, bw, bh = box if len(box) == 4 and box[2] > 0 and box[3] > 0 else (0.0, 0.0, w, h)
        if self.canvas != (cols, rows, x0, y0, bw, bh):
            self.canvas = cols, rows, x0, y0, bw, bh
            self.masks, self.held = {}, 0
            self.x = x0 + (np.arange(cols) + 0.5) * bw / cols
            self.y = y0 + (np.arange(rows)[:, None] + 0.5) * bh / rows
            self.xs, self.ys = self.x.tolist(), self.y[:, 0].tolist()
        self.pixels = np.zeros((rows, cols, 4), np.uint8)
        #: The same pixels as one number each, until something blends.
        self.packed = self.pixels.view(np.uint32)[..., 0]
        stack = [(root, {"fill": "black", "stroke": None, "stroke-width": "1"}, 1.0)]
        while stack:
            element, style, opacity = stack.pop()
            tag = markup.local_name(element)
            if tag in _SILENT:
                continue
            if element.get("transform"):
                raise SvgQualityError("SVG render failed: transform")
            own = {k: v for k, v in element.items() if k in _INHERITED}
            if element.get("style"):
                own |= _declared(element.get("style"))
            if own:
                if "opacity" in own:
                    opacity *= min(1.0, max(0.0, _length(own.pop("opacity"), 1.0)))
                style = style | own
            if tag in ("svg", "g", "a"):
                stack += [(c, style, opacity) for c in reversed(element)]
            elif tag in _GEOMETRY:
                self._shape(tag, element, style, opacity)
            elif tag == "text":
                self._text(element, style, opacity)
            elif tag:
                raise SvgQualityError(f"SVG render failed: element {tag}")
        return self.pixels if self.packed is not None else np.rint(self.pixels).astype(np.uint8)

    def _window(self, points: np.ndarray, margin: float = 0.0) -> tuple[slice, slice]:
        """Rows and columns of pixels that a shape can reach: all work on it stays inside."""
        xs, ys = points.T.tolist()
        rows = slice(bisect_left(self.ys, min(ys) - margin), bisect_right(self.ys, max(ys) + margin))
        return rows, slice(bisect_left(self.xs, min(xs) - margin), bisect_right(self.xs, max(xs) + margin))

    def _box(self, x0: float, y0: float, x1: float, y1: float) -> tuple[slice, slice]:
        """The window of a rectangle along the axes, as ``_inside`` would tell it: that window is its mask."""
        return slice(bisect_right(self.ys, y0), bisect_right(self.ys, y1)), slice(bisect_left(self.xs, x0), bisect_left(self.xs, x1))

    def _paint(self, window: tuple[slice, slice], mask: np.ndarray | None, value: tuple[int, int, int], opacity: float) -> None:
        """Colour the pixels of a window that are in the mask, or all."""
        if opacity == 1 and self.packed is not None:
            number = int.from_bytes(bytes((*value, 255)), sys.byteorder)
            if mask is None:
                self.packed[window] = number
            else:
                np.copyto(self.packed[window], np.uint32(number), where=mask)
            return
        if self.packed is not None:
            self.pixels, self.packed = self.pixels.astype(np.float64), None
        pixels = self.pixels[window]
        if mask is None:
            mask = np.ones(pixels.shape[:2], bool)
        if opacity == 1:
            pixels[mask] = (*value, 255)
            return
        under, alpha = pixels[mask], opacity
        left = under[:, 3:] / 255 * (1 - alpha)
        total = np.maximum(alpha + left, 1e-9)
        pixels[mask] = np.concatenate([(np.array(value) * alpha + under[:, :3] * left) / total, total * 255], axis=1)

    def _inside(self, points: np.ndarray, window: tuple[slice, slice]) -> np.ndarray:
        y, x = self.y[window[0]], self.x[None, window[1]]
        odd = np.zeros((y.shape[0], x.shape[1]), bool)
        corners = points.tolist()
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            if ay != by:
                crosses = (y > min(ay, by)) & (y <= max(ay, by))
                odd ^= crosses & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        return odd

    def _near(self, points: np.ndarray, closed: bool, half: float, window: tuple[slice, slice]) -> np.ndarray:
        y, x = self.y[window[0]], self.x[None, window[1]]
        near = np.zeros((y.shape[0], x.shape[1]), bool)
        corners = points.tolist()
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1] * closed):
            dx, dy = bx - ax, by - ay
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
            near |= (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 <= half * half
        return near

    def _text(self, element, style: dict, opacity: float) -> None:
        """Words as boxes over their base line, in the fill colour; parts go on where the last one ended unless they have a place of their own."""
        size, fill = _length(style.get("font-size"), 16.0), colour(style["fill"])
        at = [_length(element.get("x"), 0.0), _length(element.get("y"), 0.0)]
        parts = [(element.text, element)] + [p for c in element for p in ((c.text if markup.local_name(c) == "tspan" else None, c), (c.tail, None))]
        line = " ".join("".join(t or "" for t, _ in parts).split())
        at[0] -= {"middle": 0.5, "end": 1.0}.get(style.get("text-anchor") or "", 0.0) * len(line) * size * _CHARACTER
        for text, own in parts:
            if own is not None and own is not element:
                at = [_length(own.get(a), v) + _length(own.get("d" + a), 0.0) for a, v in zip("xy", at)]
            for word in re.findall(r"\S+|\s+", text or ""):
                wide = len(word) * size * _CHARACTER if word.strip() else size * _CHARACTER
                if word.strip() and fill is not None and size > 0:
                    self._paint(self._box(at[0], at[1] - size * _HEIGHT, at[0] + wide, at[1]), None, fill, opacity)
                at[0] += wide

    def _shape(self, tag: str, e, style: dict, opacity: float) -> None:
        key = (tag, style["fill"], style["stroke"], style["stroke-width"], *[e.get(k) for k in _GEOMETRY[tag]])
        covered = self.masks.get(key)
        if covered is None:
            covered = self._covered(tag, e, style)
            self.held += sum(len(k or "") for k in key) + sum(500 + (0 if mask is None else mask.nbytes) for _, mask, _ in covered)
            if self.held > _MOST_HELD:
                self.masks, self.held = {}, 0
            self.masks[key] = covered
        for window, mask, value in covered:
            self._paint(window, mask, value, opacity)

    def _covered(self, tag: str, e, style: dict) -> list[tuple]:
        """Windows with masks (none: all of the window) and colours, in the order in which they are painted."""
        out: list[tuple] = []
        n = lambda k: _length(e.get(k), 0.0)
        if tag == "rect":
            x, y, w, h = n("x"), n("y"), n("width"), n("height")
            outlines = [(np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]), True)] if w > 0 and h > 0 else []
        elif tag in ("circle", "ellipse"):
            rx, ry = (n("r"), n("r")) if tag == "circle" else (n("rx"), n("ry"))
            t = np.linspace(0, 2 * np.pi, 49)[:-1]
            outlines = [(np.stack([n("cx") + rx * np.cos(t), n("cy") + ry * np.sin(t)], axis=1), True)] if rx > 0 and ry > 0 else []
        elif tag == "line":
            outlines = [(np.array([(n("x1"), n("y1")), (n("x2"), n("y2"))]), False)]
        elif tag == "path":
            outlines = path_points(e.get("d", ""))
        else:
            v = [float(x) for x in _NUMBER.findall(e.get("points", ""))]
            outlines = [(np.array(v[: len(v) // 2 * 2]).reshape(-1, 2), tag == "polygon")] if len(v) >= 4 else []
        fill, stroke = colour(style["fill"]), colour(style["stroke"])
        if fill is not None and tag == "rect" and outlines:
            (x0, y0), (x1, y1) = outlines[0][0][[0, 2]].tolist()
            out.append((self._box(x0, y0, x1, y1), None, fill))
        elif fill is not None and tag != "line" and outlines:
            window = self._window(np.concatenate([points for points, _ in outlines]))
            inside = self._inside(outlines[0][0], window)
            for points, _ in outlines[1:]:
                inside ^= self._inside(points, window)
            out.append((window, inside, fill))
        if stroke is not None:
            half = _length(style["stroke-width"], 1.0) / 2
            for points, closed in outlines:
                window = self._window(points, half)
                out.append((window, self._near(points, closed, half, window), stroke))
        return out


class CairoRenderer:
    """The real renderer, where it is installed. A Python worker has one thread, so it needs no lock."""

    def __init__(self) -> None:
        import cairosvg  # noqa: F401
        import PIL.Image  # noqa: F401

    def render(self, svg: str) -> np.ndarray:
        import io

        import cairosvg
        from PIL import Image

        try:
            png = cairosvg.svg2png(bytestring=svg.encode("utf-8"))
        except Exception as e:
            raise SvgQualityError(f"SVG render failed: {e}") from e
        return np.asarray(Image.open(io.BytesIO(png)).convert("RGBA"))


def default_renderer() -> Renderer:
    try:
        return CairoRenderer()
    except ImportError:
        return NumpyRenderer()


def _lanczos(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """Weights (new, old) of a windowed sinc, widened where the image shrinks."""
    scale = max(1.0, old / new)
    centre = (np.arange(new)[:, None] + 0.5) * old / new
    first, last = np.maximum(np.floor(centre - lobes * scale + 0.5), 0), np.minimum(np.floor(centre + lobes * scale + 0.5), old)
    place = np.arange(old)[None, :]
    x = (place + 0.5 - centre) / scale
    weight = np.where((np.abs(x) < lobes) & (place >= first) & (place < last), np.sinc(x) * np.sinc(x / lobes), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos resampling of RGBA pixels to another size: colours weigh by their alpha, and each axis rounds to bytes, width first."""
    if image.shape[:2] == (height, width):
        return image
    alpha = image[..., 3:].astype(np.float64)
    out = np.concatenate([np.rint(image[..., :3] * alpha / 255), alpha], axis=2)
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] != size:
            out = np.moveaxis(np.tensordot(_lanczos(out.shape[axis], size), out, (1, axis)), 0, axis)
            out = np.clip(np.rint(out), 0, 255)
    alpha = out[..., 3:]
    plain = np.where(alpha > 0, np.minimum(255, np.floor(out[..., :3] * 255 / np.maximum(alpha, 1))), 0)
    return np.concatenate([plain, alpha], axis=2).astype(np.uint8)


def on_white(image: np.ndarray) -> np.ndarray:
    """RGBA pixels over white, without transparency."""
    share = image[..., 3:] / 255.0
    out = np.full(image.shape, 255, np.uint8)
    out[..., :3] = np.rint(image[..., :3] * share + 255 * (1 - share))
    return out


def gallery(rows: list[list[np.ndarray | None]], cell: int = 160, gap: int = 8) -> np.ndarray:
    """One white image with a row of equal cells for each list: each picture fitted into its cell, a grey cell where there is none."""
    columns = max((len(r) for r in rows), default=0)
    out = np.full((gap + len(rows) * (cell + gap), gap + columns * (cell + gap), 4), 255, np.uint8)
    for i, row in enumerate(rows):
        for k, image in enumerate(row):
            y, x = gap + i * (cell + gap), gap + k * (cell + gap)
            if image is None:
                out[y : y + cell, x : x + cell, :3] = 224
                continue
            fit = min(1.0, cell / max(image.shape[:2]))
            h, w = (max(1, round(n * fit)) for n in image.shape[:2])
            y, x = y + (cell - h) // 2, x + (cell - w) // 2
            out[y : y + h, x : x + w] = on_white(resized(image, h, w))
    return out


def difference(clean: np.ndarray, other: np.ndarray) -> tuple[float, float]:
    """Mean squared channel difference (of 1) and share of changed pixels; the second image is brought to the size of the first."""
    other = resized(other, *clean.shape[:2])
    far = np.maximum(clean, other) - np.minimum(clean, other)
    # whole numbers, so that sums are exact in any order
    wide = far.ravel().astype(np.float64)
    changed = np.count_nonzero((far >= config.CHANGED_CHANNEL).view(np.uint32))
    return float(np.dot(wide, wide) / far.size / 255**2), float(changed / (far.shape[0] * far.shape[1]))


def read_png(content: bytes) -> np.ndarray:
    """The pixels of a file that ``png`` wrote."""
    import zlib

    at, body, size = 8, b"", (0, 0)
    while at < len(content):
        n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        part = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big")
            if part[8:] != bytes((8, 6, 0, 0, 0)):
                raise ValueError("only 8-bit RGBA pictures are read")
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], 1 + 4 * size[0])
    if lines[:, 0].any():
        raise ValueError("only unfiltered pictures are read")
    return lines[:, 1:].reshape(size[1], size[0], 4)


def render_to(renderer: Renderer, svg: str, path: str) -> None:
    """Render a drawing into a PNG file, which appears whole or not at all."""
    import os

    content = png(renderer.render(svg))
    with open(f"{path}.tmp", "wb") as f:
        f.write(content)
    os.replace(f"{path}.tmp", path)


def png(image: np.ndarray) -> bytes:
    """RGBA pixels as a PNG file."""
    import struct
    import zlib

    h, w = image.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 4)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
