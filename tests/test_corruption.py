import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from svgloom import schemas
from svgloom.errors import CorruptionError, SvgQualityError
from svgloom.functions import corrupt, markup, raster
from svgloom.operators import captions, repair
from svgloom.plans import carriers

SVG = (
    '<svg xmlns="http://www.w3.org/2000/svg" width="40" height="30"><defs><rect x="1" width="2" height="2"/></defs>'
    '<g opacity="0.9"><g><g><rect x="3" y="2" width="20" height="9" fill="#ff0000"/><circle cx="20" cy="20" r="7" stroke="blue" stroke-width="2"/></g></g></g>'
    '<text x="5" y="9" fill="black">label</text><path d="M 1 2 L 30 25 L 3 9 Z" fill="#00aa55"/><polygon points="1,1 9,9 5,20"/></svg>'
)


@pytest.mark.parametrize("name", list(corrupt.FAULTS))
@pytest.mark.parametrize("level", ["easy", "medium", "hard"])
def test_faults_change_and_repeat(name, level):
    done = 0
    for seed in range(5):
        try:
            a, b = (corrupt.FAULTS[name](markup.clean(SVG), random.Random(seed), level) for _ in range(2))
        except CorruptionError:  # such as a small number that was moved by less than a unit
            continue
        done += 1
        assert a == b != markup.clean(SVG)
        if name != "truncation":
            assert markup.is_svg(a)
            assert len(list(markup.parse(a).iter("{http://www.w3.org/2000/svg}defs"))[0]) == 1
    assert done


def test_nothing_to_corrupt():
    empty = markup.clean("<svg/>")
    for name in set(corrupt.FAULTS) - {"truncation"}:
        with pytest.raises(CorruptionError):
            corrupt.FAULTS[name](empty, random.Random(1), "easy")


def test_definition_names_with_a_capital():
    svg = markup.clean('<svg xmlns="http://www.w3.org/2000/svg"><clipPath><rect x="1"/></clipPath></svg>')
    assert corrupt.FAULTS["missing_objects"](svg, random.Random(1), "easy") != svg
    with pytest.raises(CorruptionError):
        corrupt.FAULTS["missing_objects"](svg, random.Random(1), "easy", strict=True)


def test_numbers():
    rng = random.Random(4)
    assert all(int(corrupt.shifted("3", rng, "hard")) >= 0 for _ in range(50))
    assert "." in corrupt.shifted("3.55", random.Random(1), "easy") or corrupt.shifted("3.55", random.Random(1), "easy").lstrip("-").isdigit()
    with pytest.raises(CorruptionError):
        corrupt.shifted("3px", rng, "easy")
    assert corrupt.first_number("a-2.5b") == -2.5


def test_truncation_comes_last():
    out, order = corrupt.stacked(markup.clean(SVG), ["truncation", "style_corruption"], "easy", 7)
    assert order == ["style_corruption", "truncation"] and not markup.is_svg(out)


def test_raster():
    r = raster.NumpyRenderer()
    red, blue = (r.render(f'<svg width="2" height="2"><rect width="2" height="2" fill="{c}"/></svg>') for c in ("red", "blue"))
    assert raster.difference(red, red) == (0.0, 0.0)
    assert raster.difference(red, blue) == (0.5, 1.0)
    assert raster.difference(red, r.render('<svg width="4" height="4"><rect width="4" height="4" fill="red"/></svg>')) == (0.0, 0.0)
    assert (red == np.array([255, 0, 0, 255])).all() and raster.png(red).startswith(b"\x89PNG")
    for bad in ("<svg><image/></svg>", "<svg", '<svg><rect width="1" height="1" fill="url(#a)"/></svg>', '<svg><g transform="scale(2)"/></svg>'):
        with pytest.raises(SvgQualityError):
            r.render(bad)
    assert r.render('<svg width="20" height="20"><path d="M1 1 C 5 5 8 8 19 1 q 1 1 0 9 t -3 3 s 1 1 2 2 h -9 v -2 z" fill="red"/></svg>')[:, :, 3].any()


def test_repair_rows(spark):
    rows = carriers.drawings(spark, "/root/testdata/sf0.001", close=True).limit(60).select(F.col("o_orderkey").alias("row_index"), F.lit("f").alias("filename"), "svg", "dataset")
    a, b = (sorted(map(tuple, repair.repair_rows(x).collect())) for x in (rows, rows.repartition(5)))
    assert a == b and a
    for r in (dict(zip(schemas.REPAIR.names, x)) for x in a):
        assert r["svg"] != r["corrupted_svg"] and r["render_mse"] >= 0.002 and r["changed_pixel_ratio"] >= 0.01
        assert r["corruption_count"] == len(r["corruption_type"].split("+"))
    twice = repair.repair_rows(rows, levels=("easy",), per_row=2, least_mse=0, least_share=0).collect()
    assert {(r.render_mse, r.changed_pixel_ratio) for r in twice} == {(0.0, 0.0)} and len(twice) > 60


def test_caption_rows(spark):
    from svgloom import config

    raw = spark.createDataFrame([(0, "<svg><rect/></svg>", "one"), (1, "<svg><rect/>", None), (2, "<svg", "three"), (3, None, "x"), (4, "<svg><text/></svg>", "five")], "row_index long, svg string, prompt string")
    own = {r.row_index: r for r in captions.caption_rows(raw, config.source("animal_illustrations"), "train").collect()}
    assert own[0].keep and own[0].text == "one" and own[0].filename == "animal_illustrations_train_000000.svg"
    assert own[1].keep and own[1].text == "None" and own[1].svg.endswith("</svg>") and own[4].keep
    assert not own[2].keep and own[2].text is None and own[2].svg == "<svg" and own[2].error.startswith("SVG parse failed")
    checked = config.source("vfig_shapes")
    told = {r.row_index: r for r in captions.caption_rows(raw.withColumn("filename", F.lit("n")), checked, "train", renderer=raster.NumpyRenderer()).collect()}
    assert told[0].keep and told[0].text.startswith("image of") and not told[4].keep and "no geometric" in told[4].error
    final = captions.final_rows(spark.createDataFrame(list(own.values())), 1).collect()
    assert len(final) == 1 and final[0].filename == own[0].filename
