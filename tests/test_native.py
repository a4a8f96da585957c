import hashlib

import pytest
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.functions import markup, native


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first().x


@pytest.mark.parametrize("svg", ["<svg><svg>", "<svg></svg>", "<svg/>", "<svg>   \n", "<svg a='1'><rect/>\t", "", "no drawing ", "<svg <svg >", "<svg></svg ></svg>"])
def test_closing_tags_as_python_gives_them(spark, svg):
    assert one(spark, native.closed_svg(F.col("s")), s=svg) == markup.closed(svg)


def test_extraction(spark):
    simple = '<svg width="16" height="12"><rect fill="red"/></svg>'
    assert one(spark, native.extracted_svg(F.col("s")), s=f"Here: {simple} and </svg>") == simple
    assert one(spark, native.extracted_svg(F.col("s")), s="<svg><rect/></svg") is None
    assert one(spark, native.extracted_svg(F.col("s")), s="</svg> first <svg>a</svg>") == "<svg>a</svg>"


def test_split_keeps_equal_drawings_together(spark):
    rows = [("a", 1), ("b", 2), ("a", 3)] + [(f"d{k}", k) for k in range(500)]
    got = spark.createDataFrame(rows, "svg string, k long").select("svg", "k", native.split_of(F.col("svg")).alias("split")).collect()
    by = {}
    for r in got:
        by.setdefault(r.svg, set()).add(r.split)
        d = hashlib.sha256(r.svg.encode()).hexdigest()
        u = int.from_bytes(hashlib.sha256(f"42:{d}".encode()).digest()[:8], "big") / 2**64
        assert r.split == ("train" if u < 0.8 else "test" if u < 0.8 + 0.1 else "val")
    assert all(len(s) == 1 for s in by.values()) and {r.split for r in got} == {"train", "test", "val"}


def test_null_source_text_is_the_word_none(spark):
    d = spark.createDataFrame([(None,)], "t string")
    assert d.select(native.source_text(F.col("t")).alias("x")).first().x == "None"
    assert d.select(native.or_default(F.col("t"), "d").alias("x")).first().x == "d"


def test_scalars(spark):
    assert one(spark, native.first_number(F.col("s"), 3.0), s="a -1.50px 7") == -1.5
    assert one(spark, native.first_number(F.col("s"), 3.0), s="none") == 3.0
    assert one(spark, native.retry_seconds(F.col("h"), F.col("m"), F.col("k")), h="x", m="busy", k=9) == 8.0
    assert one(spark, native.percent(F.col("s")), s=0.4567) == "45.7%"
    assert one(spark, native.local_tag(F.col("s")), s="{http://x}RECT") == "rect"
    assert one(spark, native.in_truncation_folder(F.col("s")), s="a/truncation/b") and not one(spark, native.in_truncation_folder(F.col("s")), s="a/truncations/b")


def test_quality_in_order_and_at_the_border(spark):
    def why(*counts):
        return one(spark, native.quality_error(F.col("a"), F.col("b"), F.col("c")), a=counts[0], b=counts[1], c=counts[2])

    assert why(0, 0, 0).endswith("no geometric elements found.")
    assert why(2, 0, 3) is None and "0.25 < 0.40" in why(1, 0, 3)
    assert why(50, 0, 50) is None and why(60, 0, 51).endswith("complex shape count 51 > 50.")


def test_unknown_label_style(spark):
    assert one(spark, native.label_prompt(F.col("s")), s="concise") == config.label_prompt("concise")
    with pytest.raises(Exception, match="Unknown caption style `x`. Available styles: concise, detailed"):
        one(spark, native.label_prompt(F.col("s")), s="x")
    with pytest.raises(ValueError, match="Unknown caption style"):
        config.label_prompt("x")


def test_acceptance(spark):
    def why(mse, share):
        return one(spark, native.acceptance_error(F.col("m"), F.col("s")), m=mse, s=share)

    assert why(0.002, 0.01) is None and why(0.0019, 1.0).startswith("render MSE") and why(1.0, 0.009).startswith("changed pixel ratio")


def test_required_splits():
    with pytest.raises(ValueError, match="Dataset is missing required splits: test, val"):
        schemas.require_splits(["train"])


def test_clean():
    assert markup.clean("<svg><svg>").count("svg") == 1 or "<svg" in markup.clean("<svg><svg>")
    nested = markup.clean('<svg width="9" height="1"><rect/><svg height="2"><line/></svg></svg>')
    assert 'width="9"' in nested and 'height="2"' in nested and "rect" not in nested
    assert markup.clean(markup.clean("<svg><rect/>")) == markup.clean("<svg><rect/>")
    assert markup.unescaped(r"\x3csvg\x3e\x3c/svg\x3e") == "<svg></svg>" and markup.unescaped(r"\x41") == r"\x41"
    assert markup.shape_counts('<s:svg xmlns:s="http://www.w3.org/2000/svg"><s:RECT/><s:polyline/><s:path/><s:text/></s:svg>') == (1, 1, 1)
    assert not markup.is_svg("<html></html>") and not markup.is_svg("<svg>") and not markup.is_svg('<!DOCTYPE x [<!ENTITY a "b">]><svg/>')
