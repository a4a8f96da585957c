"""What large tables need: work spread over the cores, nothing made twice, and short cuts that give what the plain way gives."""

import random

import numpy as np
import pytest

from svgloom import config
from svgloom.errors import CorruptionError
from svgloom.functions import corrupt, markup, raster
from svgloom.operators import repair
from svgloom.plans import catalog, coverage
from svgloom.sources import sinks, tables

SF = "/root/testdata/sf0.001"
ODD = [
    '<svg xmlns="http://www.w3.org/2000/svg" width="9"><g id="a&amp;b&quot;&#10;&#9;&lt;"> x &amp; &lt; y <text>l&gt;"</text>tail<rect/></g>\n</svg>',
    '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink"><use xlink:href="#a"/><rect/></svg>',
    '<svg width="2"><rect width="1"/></svg>',
    '<svg xmlns="http://www.w3.org/2000/svg"><a xmlns="http://x/"><rect/></a><b xmlns=""><rect/></b><text xml:space="preserve"> é</text></svg>',
    '<x:svg xmlns:x="http://www.w3.org/2000/svg"><x:rect/><!-- c --></x:svg>',
]


def test_python_work_on_few_bytes_is_spread(spark):
    assert coverage.fault_effects(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("svg", ODD)
def test_markup_is_written_as_elementtree_writes_it(svg):
    root = markup.parse(svg)
    assert markup.write(root) == markup.ET.tostring(root, encoding="unicode")


def test_faults_on_shared_trees_are_those_on_fresh_ones(monkeypatch):
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><g><rect x="3" width="9"/><g><circle r="7" stroke="#123123"/></g></g><text x="5">a&#13;b</text><path d="M 1 2 L 30 25"/><polygon points="1,1 9,9"/></svg>'

    def tried():
        out = []
        for seed in range(150):
            try:
                out.append(corrupt.stacked(svg, corrupt.drawn_types(list(corrupt.FAULTS), random.Random(seed)), "medium", seed))
            except CorruptionError as e:
                out.append(str(e))
        return out

    shared = tried()
    monkeypatch.setattr(markup.TREES, "own", markup.parse)
    monkeypatch.setattr(markup.TREES, "write", markup.write)
    assert shared == tried()


def test_no_level_is_made_that_nobody_asked_for(spark, monkeypatch):
    asked, made = [], repair.repair_rows
    monkeypatch.setattr(repair, "repair_rows", lambda rows, levels=config.LEVELS: asked.append(levels) or made(rows, levels))
    got = catalog.truncated_engine(spark, SF)
    assert asked == [("hard",)] and {r.corruption_level for r in got.collect()} == {"hard"}


def test_repair_work_is_spread(spark):
    rows = spark.createDataFrame([(k, "f", "<svg/>") for k in range(9)], "row_index long, filename string, svg string").coalesce(1)
    assert repair.repair_rows(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_try_that_must_fail_does_nothing(monkeypatch):
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><rect width="9"/><g/><rect/><defs><text>a</text></defs></svg>'
    assert corrupt.hopeless(svg) == {"text_corruption", "group_flattening"}
    assert corrupt.hopeless("<svg><g><text>a</text></g></svg>") == corrupt.hopeless("<svg") == frozenset()
    monkeypatch.setitem(corrupt.FAULTS, "missing_objects", lambda *a: pytest.fail("a fault was done"))
    with pytest.raises(CorruptionError):
        corrupt.stacked(svg, ["missing_objects", "text_corruption"], "easy", 1)


def test_remembered_shapes_are_those_drawn_afresh(monkeypatch):
    rng = random.Random(5)
    shapes = [
        '<rect x="{}" y="3" width="9" height="9" fill="red"{}/>', '<circle cx="{}" cy="9" r="6" stroke="blue"{}/>', '<path d="M {} 1 L 9 20 L 3 9 Z" fill="#00aa55"{}/>',
        '<line x1="{}" x2="19" y2="9" stroke="#0066ff" stroke-width="3"{}/>', '<polygon points="{},1 9,9 2,19" style="fill:none;stroke:red"{}/>',
    ]
    kept = raster.NumpyRenderer()
    drawings = [f'<svg width="{rng.choice((24, 30))}" height="20">' + "".join(rng.choice(shapes).format(rng.randint(0, 3), rng.choice(("", "", ' opacity="0.4"'))) for _ in range(4)) + "</svg>" for _ in range(80)]
    for svg in drawings:
        assert (kept.render(svg) == raster.NumpyRenderer().render(svg)).all(), svg
    kept.render(drawings[0])
    monkeypatch.setattr(raster.NumpyRenderer, "_covered", lambda *a: pytest.fail("a shape was drawn again"))
    kept.render(drawings[0])


def test_bytes_and_blended_pixels_agree():
    opaque = '<svg width="9" height="9"><rect width="5" height="5" fill="red"/><circle cx="5" cy="5" r="3" fill="blue"/></svg>'
    # the same pixels, blended with nothing outside
    blended = opaque.replace("</svg>", '<rect x="20" width="5" height="5" opacity="0.5"/></svg>')
    assert (raster.NumpyRenderer().render(opaque) == raster.NumpyRenderer().render(blended)).all()
    a, b = (np.random.default_rng(k).integers(0, 256, (7, 5, 4), dtype=np.uint8) for k in (1, 2))
    far = abs(a.astype(int) - b)
    assert raster.difference(a, b) == ((far.astype(float) ** 2).mean() / 255**2, (far >= config.CHANGED_CHANNEL).any(axis=2).mean())


def test_publishing_replaces_what_has_no_mark(spark, tmp_path):
    at = f"file://{tmp_path}"
    sinks.write_text(spark, f"{at}/staged/a/rows", "new")
    sinks.write_text(spark, f"{at}/out/A/left", "of a run that was cut off")
    tables.publish(spark, {f"{at}/staged/a": f"{at}/out/A", f"{at}/staged/b": f"{at}/out/B"}, "COMMITTED", "whole\n")
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("[!.]*") if p.is_file()) == ["out/A/COMMITTED", "out/A/rows", "out/B/COMMITTED"]
    assert (tmp_path / "out/B/COMMITTED").read_text() == "whole\n"
    tables.publish(spark, {}, "COMMITTED", "whole\n")
