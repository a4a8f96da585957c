import pytest

from svgloom.errors import SvgExtractionError, TextLabelError
from svgloom.functions import raster
from svgloom.operators import batches, evaluation, predictions
from pyspark.sql import functions as F

RED = '<svg width="4" height="4"><rect width="4" height="4" fill="red"/></svg>'


def test_calls_and_evaluation(spark):
    class Failing:
        async def generate(self, prompt):
            if "bad" in prompt:
                raise TimeoutError("too slow")
            return RED

    d = spark.createDataFrame([(0, "good", RED), (1, "bad", RED), (2, "fine", RED.replace("red", "blue"))], "output_index long, prompt string, svg string")
    out = predictions.generated(d, Failing()).collect()
    assert {r.output_index: r.request_error for r in out} == {0: None, 1: "TimeoutError: too slow", 2: None}
    joined = d.join(spark.createDataFrame(out), "output_index")
    got = {r.output_index: r for r in predictions.evaluated(joined, raster.NumpyRenderer()).collect()}
    assert got[0].pixel_mse == 0.0 and got[2].pixel_mse == 0.5 and got[1].pixel_mse is None and not got[1].prediction_has_svg
    assert got[0].prediction_png.startswith(b"\x89PNG")
    done = spark.createDataFrame([(0,)], "output_index long")
    assert predictions.to_call(d, done).count() == 2 and predictions.to_call(d, done, overwrite=True).count() == 3
    assert [r.output_index for r in evaluation.assembled(d.select("output_index"), spark.createDataFrame(out)).collect()] == [0, 1, 2]


def test_extraction_error():
    assert predictions.extract("a <svg>b</svg> c") == "<svg>b</svg>"
    for bad in ("<svg><rect/></svg", "", "</svg><svg>"):
        with pytest.raises(SvgExtractionError):
            predictions.extract(bad)


def test_retries():
    class Busy(Exception):
        status = 429
        retry_after = 3.0

    class Inner:
        calls = 0

        def caption(self, image, prompt):
            self.calls += 1
            if self.calls < 3:
                raise Busy()
            return "done"

    waits = []
    assert predictions.RetryingCaptioner(Inner(), wait=waits.append).caption(b"", "p") == "done"
    assert len(waits) == 2 and all(3.0 <= w <= 3.25 for w in waits)
    with pytest.raises(TextLabelError):
        predictions.RetryingCaptioner(type("X", (), {"caption": lambda s, i, p: 1 / 0})(), wait=waits.append).caption(b"", "p")


def test_tokens(spark):
    encode = lambda texts: [[ord(c) for c in t] for t in texts]
    d = spark.createDataFrame([("ab",), (None,)], "svg string")
    assert [r.x for r in d.select(batches.target_ids(F.col("svg"), encode, "!").alias("x")).collect()] == [[97, 98, 33, 10], [33, 10]]
