import math

import pytest
from pyspark.sql import functions as F

from carteel.functions import affine, buckets, names
from carteel.functions import labels as label_functions


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


A = {"a": 0.8453, "b": 0.0012, "c": -0.0009, "d": -0.8421, "e": 139250.5, "f": 1130420.25}


def lit(t):
    return {k: F.lit(v) for k, v in t.items()}


def test_round_trip(spark):
    x, y = affine.pixel_to_map(F.lit(4321.0), F.lit(8765.0), lit(A))
    px, py = affine.map_to_pixel(x, y, lit(A))
    got = one(spark, px.alias("px"), py.alias("py"))
    assert got.px == pytest.approx(4321, abs=1e-6) and got.py == pytest.approx(8765, abs=1e-6)


def test_no_inverse_is_null(spark):
    px, py = affine.map_to_pixel(F.lit(1.0), F.lit(2.0), lit(A | {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}))
    assert one(spark, px, py)[:] == (None, None)


def test_scales_round_half_to_even(spark):
    got = one(spark, *[affine.dpi_scale(F.lit(d)) for d in (0, 600, 400, 300, 480, 598)])
    assert got[:] == (1.0, 1.0, 1.5, 2.0, 1.0, 1.0)
    assert one(spark, *[affine.width_scale(F.lit(w)) for w in (20000, 14000, 11200, 8000, 5600)])[:] == (1.0, 1.0, 1.0, 2.0, 2.5)


def test_polynomial(spark):
    x, y = affine.polynomial(F.lit(2.0), F.lit(3.0), F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])), F.array(*map(F.lit, [0.0] * 5 + [1.0])))
    assert one(spark, x, y)[:] == (1 + 4 + 9 + 24 + 20 + 54, 9.0)


def test_pixel_sizes(spark):
    one_, two = affine.pixel_sizes({"a": F.lit(3.0), "b": F.lit(0.0), "c": F.lit(0.0), "d": F.lit(-2.0), "e": F.lit(0.0), "f": F.lit(0.0)})
    assert one(spark, one_, two)[:] == pytest.approx((3.0, 2.0))


@pytest.mark.parametrize(
    "name,expect",
    [
        ("14-15-Lydda-1942.jpg", (1_150_000, 1_160_000, 140_000, 150_000)),
        ("dir/14-15-Lydda-1942.tif", (1_150_000, 1_160_000, 140_000, 150_000)),
        ("1415-24-Haifa-1942.jpg", (1_240_000, 1_250_000, 140_000, 160_000)),
        ("10-1112-Foo-1948", (1_110_000, 1_130_000, 100_000, 110_000)),
        ("M5_4598.jpg", None),
    ],
)
def test_sheet_ranges(spark, name, expect):
    got = one(spark, names.sheet_ranges(F.lit(name)))[0]
    assert (got and tuple(got)) == expect


def test_label_ranges(spark):
    got = one(spark, names.label_ranges(F.lit("14-15-X-1942.jpg")), names.label_ranges(F.lit("M5_4598.jpg")))
    assert tuple(got[0]) == (139, 151, 149, 161) and got[1] is None


def test_crop_names(spark):
    got = one(spark, names.crop(F.lit("M9_4149_x12_y-3_c0.75_gt.png")), names.crop(F.lit("M9_x1_y2.png")), names.crop(F.lit("other.png")))
    assert tuple(got[0]) == ("M9_4149", 12, -3, 0.75, "gt") and tuple(got[1]) == ("M9", 1, 2, None, None) and got[2] is None
    assert one(spark, names.crop_confidence(F.lit("a_c0.5.png")), names.crop_confidence(F.lit("a.png")))[:] == (0.5, 1.0)
    assert one(spark, names.held_out_map(F.lit("M1_x"), ["M2", "M1"]), names.held_out_map(F.lit("M11_x"), ["M1"]))[:] == ("M1", None)
    assert one(spark, names.point_name(F.lit("12A")), names.point_name(F.lit("x2B")))[:] == ("12/A", "x2B")
    assert one(spark, names.point_height(F.lit("12.5"), F.lit(0.3)), names.point_height(F.lit("12.5"), F.lit(0.1)), names.point_height(F.lit("x"), F.lit(1.0)))[:] == (12.5, None, None)


def test_digit_variants(spark):
    got = one(spark, label_functions.digit_variants(F.lit(181)), label_functions.digit_variants(F.lit(131)))
    assert 131 in got[0] and 181 in got[1] and 131 not in got[1]


@pytest.mark.parametrize("value,lo,hi,expect", [(181, 129, 141, 131), (61, 129, 141, None), (86, 30, 80, None)])
def test_rescue(spark, value, lo, hi, expect):
    assert one(spark, label_functions.rescued(F.lit(value), F.lit(lo), F.lit(hi)))[0] == expect


def test_zone_and_acceptance(spark):
    assert one(spark, label_functions.without_zone(F.lit(1130), F.lit(100), F.lit(150)))[0] == 130
    got = one(spark, label_functions.accepted(F.lit(181), F.lit(0.8), F.lit(129), F.lit(141)), label_functions.accepted(F.lit(61), F.lit(0.8), F.lit(129), F.lit(141)))
    assert got[0].value == 131 and got[0].confidence == pytest.approx(0.72) and got[1] is None


def test_fusion_and_gate(spark):
    got = one(spark, buckets.fused_score(F.lit(0.98), F.lit(0.3)), buckets.fused_score(F.lit(0.4), F.lit(0.5)), buckets.gated(F.lit(0.9), F.lit("edge"), F.lit(0.2)), buckets.gated(F.lit(0.9), F.lit("edge"), F.lit(None).cast("double")))
    assert got[0].score == pytest.approx(1.029) and got[0].method == "combined"
    assert (got[1].score, got[1].method) == (0.5, "edge")
    assert got[2].confidence == pytest.approx(0.02) and got[2].method == "cnn_rejected" and got[3].confidence == 0.9


def test_classes(spark):
    assert one(spark, *[buckets.error_status(F.lit(v)) for v in (7.0, 15.0, 15.1)])[:] == ("automatic", "refine", "excessive")
    assert one(spark, *[buckets.error_colour(F.lit(v)) for v in (24.9, 25.0, 70.0)])[:] == ("green", "amber", "red")
    assert one(spark, *[buckets.confidence_class(F.lit(v)) for v in (0.7, 0.5, 0.1)])[:] == ("high", "medium", "low")


def test_frames(spark):
    got = one(spark, affine.inch_frames(F.lit(2.0), F.lit(3.0), F.lit(100), F.lit(1000)))[0]
    assert [(r.frame, r.px, r.py) for r in got] == [("up", 200, 700), ("down", 200, 300)]
    assert math.isclose(got[0].px, 200)
