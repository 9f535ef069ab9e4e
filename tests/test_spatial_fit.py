import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from carteel.operators import dataset, evaluate, fit, spatial

T = {"a": 0.85, "b": 0.002, "c": -0.001, "d": -0.84, "e": 189000.0, "f": 630000.0}


def observations(spark, points, noise=None):
    rows = []
    for i, (px, py) in enumerate(points):
        dx, dy = noise[i] if noise else (0.0, 0.0)
        rows.append(("m", i + 1, float(px), float(py), T["a"] * px + T["c"] * py + T["e"] + dx, T["b"] * px + T["d"] * py + T["f"] + dy))
    return spark.createDataFrame(rows, "map_id string, id int, px double, py double, x double, y double")


def test_exact_fit(spark):
    got = fit.fit_affine(observations(spark, [(100, 200), (9000, 150), (300, 11000), (8000, 9000)])).first()
    for k, v in T.items():
        assert got[k] == pytest.approx(v, abs=1e-6)
    assert got.rmse_component_m < 1e-6


def test_collinear_and_few_points_have_no_fit(spark):
    assert fit.fit_affine(observations(spark, [(0, 0), (1, 1), (2, 2), (3, 3)])).count() == 0
    assert fit.fit_affine(observations(spark, [(0, 0), (1, 5)])).count() == 0


def test_rmse_kinds_differ_by_root_two(spark):
    draw = np.random.default_rng(0)
    got = fit.fit_affine(observations(spark, draw.uniform(0, 9000, (20, 2)).tolist(), draw.normal(0, 5, (20, 2)).tolist())).first()
    assert got.rmse_radial_m == pytest.approx(got.rmse_component_m * 2**0.5)


def test_trim(spark):
    draw = np.random.default_rng(1)
    points = draw.uniform(0, 9000, (30, 2)).tolist()
    noise = [(0.0, 0.0)] * 28 + [(300.0, 0.0), (0.0, -400.0)]
    got = fit.trim_and_refit(observations(spark, points, noise)).first()
    assert (got.n, got.n_inliers) == (30, 28) and got.a == pytest.approx(T["a"], abs=1e-6)


def test_consensus_finds_planted_outliers(spark):
    draw = np.random.default_rng(2)
    points = draw.uniform(0, 9000, (12, 2)).tolist()
    noise = [(0.0, 0.0)] * 8 + [(100.0 + 50 * i, 70.0 * i) for i in range(4)]
    rows = observations(spark, points, noise)
    for kept in (fit.consensus_affine(rows), fit.sampled_consensus(rows)):
        assert sorted(r.id for r in kept.collect()) == list(range(1, 9))
    assert fit.consensus_affine(observations(spark, points[:4])).count() == 0


def test_polynomial(spark):
    draw = np.random.default_rng(3)
    p = draw.uniform(0, 1000, (20, 2))
    c = np.array([5.0, 1.0, 2.0, 1e-4, 2e-4, -1e-4])
    x = np.column_stack([np.ones(20), p, p[:, 0] * p[:, 1], p[:, 0] ** 2, p[:, 1] ** 2]) @ c
    got = fit.fit_polynomial(spark.createDataFrame([("m", *map(float, q), float(v), float(v)) for q, v in zip(p, x)], "map_id string, px double, py double, x double, y double")).first()
    assert got.cx == pytest.approx(c.tolist(), abs=1e-6) and got.rmse_component_m < 1e-6


def test_box_join_is_the_plain_one(spark):
    draw = np.random.default_rng(4)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(draw.uniform(0, 1000, (200, 2)))], "pid int, x double, y double")
    boxes = spark.createDataFrame([(i, float(a), float(a + 150), float(b), float(b + 90)) for i, (a, b) in enumerate(draw.uniform(0, 900, (10, 2)))], "map_id int, min_x double, max_x double, min_y double, max_y double")
    one, two = (sorted((r.map_id, r.pid) for r in spatial.box_join(points, boxes, "x", "y", 20, bin_size=s).collect()) for s in (spatial.box_side(boxes, 20), 70.0))
    assert one == two and one
    plan = spatial.box_join(points, boxes, "x", "y", 20, bin_size=70.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_window_bounds(spark):
    rows = spark.createDataFrame([(32.0, 32.0), (31.4, 50.0), (31.5, 50.0), (67.4, 50.0), (67.5, 50.0), (68.5, 50.0)], "px double, py double")
    got = [r[0] for r in rows.select(spatial.in_frame(F.col("px"), F.col("py"), F.lit(32), F.lit(100), F.lit(100))).collect()]
    assert got == [True, False, True, True, False, False]


def test_nearest_match(spark):
    det = spark.createDataFrame([("m", 1, 0.0, 0.0), ("m", 2, 1.0, 0.0), ("m", 3, 100.0, 0.0), ("m", 4, 130.0, 0.0)], "map_id string, det int, px double, py double")
    truth = spark.createDataFrame([("m", 7, 0.5, 0.0), ("m", 8, 20.0, 0.0), ("m", 9, 100.0, 0.0)], "map_id string, gt int, qx double, qy double")
    got = sorted((r.det, r.gt) for r in spatial.match_nearest(det, truth).collect())
    assert got == [(1, 7), (3, 9)]  # 2 has 7 nearest and isn't matched to 8; 4 is exactly 30 away
    assert len(spatial.match_nearest(det, truth, one_to_one=False).collect()) == 3


def brute_spread(rows, n, d):
    kept = []
    for _, x, y in sorted(rows):
        if len(kept) < n and all(((x - a) ** 2 + (y - b) ** 2) ** 0.5 >= d for _, a, b in kept):
            kept.append((_, x, y))
    return [k[0] for k in kept]


@pytest.mark.parametrize("seed", range(3))
def test_spread_and_suppression(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(draw.integers(0, 60, (80, 2)))]
    df = spark.createDataFrame([("m", *r) for r in rows], "map_id string, id int, px double, py double")
    got = [r.id for r in spatial.select_spread(df, ["id"], ["id"], 10, 12.0).orderBy("pick").collect()]
    assert got == brute_spread(rows, 10, 12.0)
    assert [r.id for r in spatial.suppress(df, ["id"], ["id"], 9.0).orderBy("pick").collect()] == brute_spread(rows, 10**9, 9.0)


def test_spread_of_rows_without_position(spark):
    df = spark.createDataFrame([("m", 1, None, 0.0), ("m", 2, 0.0, 0.0), ("m", 3, 12.0, 0.0), ("m", 4, 11.9, None), (None, 5, 1.0, 1.0)], "map_id string, id int, px double, py double")
    assert sorted((r.map_id or "", r.id) for r in spatial.select_spread(df, ["id"], ["id"], 10, 12.0).collect()) == [("", 5), ("m", 2), ("m", 3)]
    assert [r.id for r in spatial.select_spread(df.filter("id < 5"), ["id"], ["id"], 10, 12.0, strict=True).collect()] == [2]
    assert spatial.select_spread(df.limit(0), ["id"], ["id"]).count() == 0


def test_thin_new(spark):
    new = spark.createDataFrame([("m", 1, 0.0, 0.0), ("m", 2, 10.0, 0.0), ("m", 3, 10.1, 0.0), ("m", 4, 50.0, 0.0)], "map_id string, id int, px double, py double")
    old = spark.createDataFrame([("m", 60.0, 0.0)], "map_id string, qx double, qy double")
    assert sorted(r.id for r in spatial.thin_new(new, old).collect()) == [1, 3]


def test_name_or_height(spark):
    points = spark.createDataFrame([(1, "A", 10.0), (2, "A", 11.0), (3, "B", 100.0), (4, "C", 100.5), (5, "D", 200.0)], "pid int, name string, height double")
    read = spark.createDataFrame([(1, "A", None), (2, "x", 100.2), (3, "x", 200.9), (4, "x", 201.2), (5, None, None)], "id int, name string, height double")
    assert sorted(map(tuple, spatial.match_by_name_or_height(read, points).collect())) == [(1, 2, "name"), (3, 5, "height")]


def test_evaluation_of_nothing_is_nan(spark):
    fits = fit.fit_affine(observations(spark, [(0, 0), (9000, 150), (300, 11000)]))
    truth = spark.createDataFrame([("m", 0.0, 0.0, 1.0, 1.0, 0)], "map_id string, px double, py double, x double, y double, enable int")
    got = evaluate.transform_error(truth, fits).first()
    assert got.n == 0 and np.isnan(got.mean_m) and np.isnan(got.median_m)


def test_reports(spark):
    det = spark.createDataFrame([("m", 1), ("m", 2), ("k", 1)], "map_id string, det int")
    truth = spark.createDataFrame([("m", 1), ("m", 2), ("m", 3)], "map_id string, gt int")
    match = spark.createDataFrame([("m", 1, 1, 2.0)], "map_id string, det int, gt int, distance double")
    got = {r.map_id: r for r in evaluate.detection_report(det, truth, match).collect()}
    assert got["m"].precision == 0.5 and got["m"].recall == pytest.approx(1 / 3) and got[None].is_total and got[None].precision == pytest.approx(1 / 3) and got["k"].recall == 0
    scored = spark.createDataFrame([(0.9, 1, "a"), (0.5, 0, "a"), (0.1, 1, "b"), (0.2, 0, "b")], "prob double, label int, source string")
    total = evaluate.confusion(scored).first()
    assert total[:4] == (1, 1, 1, 1) and total.f1 == pytest.approx(0.5)


def test_threshold_for_recall(spark):
    rows = spark.createDataFrame([(0, p, y) for p, y in [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1), (0.2, 0)]], "fold int, prob double, label int")
    got = evaluate.threshold_for_recall(rows, 0.6).first()
    assert got.threshold == 0.7 and got.precision == pytest.approx(2 / 3)


def test_label_actions(spark):
    files = spark.createDataFrame([("positive", "a.png"), ("hard_negative", "b.png"), ("qa", "c.jpg"), ("partial", "b.png")], "folder string, file_name string")
    marks = spark.createDataFrame([("positive", "a.png", "neg"), ("hard_negative", "b.png", "partial"), ("qa", "c.png", "pos"), ("positive", "gone.png", "neg"), ("positive", "a.png", "skip")], "folder string, file_name string, label string")
    got = sorted((r.file_name, r.action, r.goal, r.skipped) for r in dataset.label_actions(marks, files).collect())
    assert got == [("a.png", "move", "negative", False), ("b.png", "copy", "partial", True), ("c.jpg", "copy", "positive", False)]


def test_split(spark):
    rows = spark.createDataFrame([(f"f{i}", int(i < 10)) for i in range(33)], "file_name string, label int")
    got = {(r.label, r.split): r["count"] for r in dataset.split(rows).groupBy("label", "split").count().collect()}
    assert got == {(1, "train"): 8, (1, "val"): 2, (0, "train"): 18, (0, "val"): 5}
    assert sorted(dataset.split(rows).collect()) == sorted(dataset.split(rows).collect())


def test_split_by_order_and_null_class(spark):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "n int, label int")
    want = {}
    for label in (None, 0, 1, 2):
        mine = sorted(i for i, y in rows if y == label)
        want |= {i: "train" if k < int(0.8 * len(mine)) else "val" for k, i in enumerate(mine)}
    assert {r.n: r.split for r in dataset.split(df, [F.col("n")]).collect()} == want
    weights = {r.n: r.weight for r in dataset.class_weights(df).collect()}
    assert weights == pytest.approx({i: 1 / sum(z == y for _, z in rows) for i, y in rows})
    assert dataset.split(df.limit(0), [F.col("n")]).count() == 0


def test_training_sample(spark):
    rows = [("positive", f"p{i}") for i in range(6)] + [("partial", "q")] + [("negative", f"n{i}") for i in range(30)] + [("hard_negative", f"hn{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "folder string, file_name string")
    assert dataset.training_sample(df).count() == 42
    got = dataset.training_sample(df, ratio=1.5).collect()
    bad = [r.file_name for r in got if r.label == 0]
    assert len(bad) == 10 and sum(b.startswith("hn") for b in bad) == 5
    assert {r.file_name for r in dataset.training_sample(df, ratio=0.5, partials=False).collect() if r.label == 0} < {f"hn{i}" for i in range(5)}


def test_held_out_and_rescued(spark):
    held = spark.createDataFrame([("M1",)], "map_id string")
    crops = spark.createDataFrame([("M1_x1_y1.png",), ("M11_x1_y1.png",)], "file_name string")
    assert [r.file_name for r in dataset.without_held_out(crops, held).collect()] == ["M11_x1_y1.png"]
    f = lambda *n: spark.createDataFrame([(x,) for x in n] or [], "file_name string")
    got = sorted(map(tuple, dataset.without_rescued(f("a", "b"), f("b", "c", "d"), f("a"), f("d")).collect()))
    assert got == [("b", "negative"), ("c", "hard_negative")]


def test_triples_count(spark):
    rows = observations(spark, list(itertools.product((0, 10, 25), (0, 7))))
    assert fit.triples(rows).count() == 20 - 2  # the two columns of three points
