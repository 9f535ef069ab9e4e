import numpy as np
import pytest

from carteel.operators import labels

LABEL = "map_id string, axis string, id long, pos double, val long, conf double"


def series(spark, rows, axis="easting"):
    return spark.createDataFrame([("m", axis, i, float(p), v, c) for i, (p, v, c) in enumerate(rows)], LABEL)


def values(df):
    return [r.val for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("vals,expect", [([130, 131, 132, 138], [130, 131, 132, 133]), ([130, 181, 132, 133], [130, 131, 132, 133]), ([140, 141, 142], [140, 141, 142])])
def test_repair(spark, vals, expect):
    got = labels.repair_digits(series(spark, [(1000 * (i + 1), v, 0.9) for i, v in enumerate(vals)])).orderBy("id").collect()
    assert [r.val for r in got] == expect
    assert [r.conf for r in got] == [pytest.approx(0.9 if a == b else 0.81) for a, b in zip(vals, expect)]


def test_repair_passes_short_series(spark):
    assert values(labels.repair_digits(series(spark, [(1000, 130, 0.9), (2000, 138, 0.9)]))) == [130, 138]


@pytest.mark.parametrize("rows,expect", [([(1000, 130), (2200, 131), (3400, 132)], [130, 131, 132]), ([(1000, 130), (2200, 131), (3400, 132), (3500, 250)], [130, 131, 132]), ([(1000, 130), (1010, 131)], []), ([(1000, 130)], [130])])
def test_validate(spark, rows, expect):
    assert values(labels.validate_sequence(series(spark, [(*r, 0.9) for r in rows]))) == expect


@pytest.mark.parametrize(
    "rows,expect",
    [
        ([(5000, 145, 0.8, "top"), (5040, 145, 0.6, "bottom")], (5020, 145, 0.8, "both")),
        ([(5000, 145, 0.8, "top")], (5000, 145, 0.8, "top")),
        ([(5000, 145, 0.9, "top"), (9000, 145, 0.4, "bottom")], (5000, 145, 0.9, "top")),
    ],
)
def test_merge(spark, rows, expect):
    df = spark.createDataFrame([("m", "easting", i, float(p), v, c, e) for i, (p, v, c, e) in enumerate(rows)], LABEL + ", edge string")
    (got,) = labels.merge_edges(df).collect()
    assert (got.pos, got.val, got.conf, got.edge) == expect


def test_consensus_two_series(spark):
    rows = [(1026 + 1170 * i, 140 - i, 0.9) for i in range(11)] + [(940 + 1170 * i, 180 - i, 0.9) for i in range(7)]
    assert sorted(values(labels.consensus(series(spark, rows)))) == list(range(130, 141))


def test_consensus_falls_back(spark):
    assert len(values(labels.consensus(series(spark, [(100, 50, 0.9), (200, 90, 0.9), (300, 51, 0.9)])))) >= 1


def test_monotonic_ties_go_by_confidence(spark):
    assert values(labels.remove_non_monotonic(series(spark, [(1, 10, 0.9), (2, 12, 0.9), (3, 11, 0.3), (4, 13, 0.9)]))) == [10, 12, 13]


PX, COL, ROW = 1183, 891, 934


def sheet(spark, east=None, north=None):
    east = east or [(COL + i * PX, 140 + i, 0.9) for i in range(11)]
    north = north or [(ROW + i * PX, 130 - i, 0.9) for i in range(11)]
    return series(spark, east).unionByName(series(spark, north, "northing"))


def fitted(spark, **rows):
    t, used = labels.label_affine(sheet(spark, **rows))
    (got,) = t.collect()
    return got, used


def test_clean_sheet(spark):
    t, used = fitted(spark)
    assert t.reject_reason is None and t.pixel_size_x == pytest.approx(1000 / PX, abs=0.01) and t.a > 0 > t.d
    assert t.easting_rmse_m < 1 and t.northing_rmse_m < 1
    assert t.a * (COL + 5 * PX) + t.e == pytest.approx(145_000, abs=50)
    lines = spark.createDataFrame([("m", ROW, ROW + 10 * PX, COL, COL + 10 * PX)], "map_id string, top int, bottom int, left int, right int")
    points = labels.grid_points(used.join(spark.createDataFrame([("both",)], "edge string")), labels.label_affine(sheet(spark))[0], lines).orderBy("axis", "id").collect()
    assert len(points) == 22 and points[0].pixel_x == COL and points[0].old_n == 140_000 and points[11].old_e == 1_130_000
    extent = labels.label_extent(used).first()
    assert (extent.old_n_min, extent.old_n_max, extent.old_e_min, extent.old_e_max) == (139_000, 151_000, 1_119_000, 1_131_000)


def test_one_misread(spark):
    east = [(COL + i * PX, 140 + i if i != 5 else 195, 0.9) for i in range(11)]
    t, _ = fitted(spark, east=east)
    assert t.pixel_size_x == pytest.approx(1000 / PX, abs=0.01) and t.easting_rmse_m < 5


def test_systematic_misread_and_junk(spark):
    east = [(COL + i * 593, 181 + i, 0.9) for i in range(9)] + [(6045, 68, 0.36)]
    north = [(ROW + i * 593, 149 - i, 0.9) for i in range(10)]
    t, _ = fitted(spark, east=east, north=north)
    assert t.pixel_size_x == pytest.approx(1000 / 593, abs=0.01) and t.easting_rmse_m < 5


def test_too_few(spark):
    t, _ = fitted(spark, north=[(ROW, 130, 0.9)])
    assert t.reject_reason == "too few labels"


def test_line_fit_drops_an_outlier(spark):
    rows = [(1000.0 * i, 100 + i, 0.9) for i in range(10)] + [(10_500.0, 150, 0.9)]
    got = labels.fit_lines(series(spark, rows)).collect()
    assert len(got) == 10 and got[0].slope == pytest.approx(1e-3) and got[0].offset == pytest.approx(100)


def test_empty(spark):
    none = series(spark, []).limit(0)
    for op in (labels.validate_sequence, labels.consensus, labels.repair_digits, labels.remove_non_monotonic, labels.sequence_score, labels.fit_lines, labels.label_extent):
        assert op(none).count() == 0


def test_clusters(spark):
    df = spark.createDataFrame([("m", p) for p in (10, 11, 13, 20, 21, 40)], "map_id string, pos int")
    assert sorted(r.line for r in labels.cluster_lines(df).collect()) == [11, 20, 40]


def test_regular_lines(spark):
    def kept(lines):
        return sorted(r.line for r in labels.regular_lines(spark.createDataFrame([("m", x) for x in lines], "map_id string, line long")).collect())

    assert kept([0, 100, 130, 200, 300]) == [0, 100, 200, 300]
    assert kept([0, 100, 200, 400]) == [0, 100, 200, 400]
    assert kept([0, 10, 20, 400]) == [0, 10, 20, 400]
    assert kept([5]) == [5]


def test_dedupe(spark):
    df = spark.createDataFrame([("m", "top", i, float(p), 1, c) for i, (p, c) in enumerate([(0, 0.5), (40, 0.9), (80, 0.4), (95, 0.1), (200, 0.3)])], "map_id string, edge string, id long, pos double, val long, conf double")
    assert sorted(r.id for r in labels.dedupe_readings(df).collect()) == [1, 3, 4]


def test_repair_scorer_agrees_with_the_column_form(spark):
    draw = np.random.default_rng(3)
    rows = [("m%d" % m, "easting", i, 1000.0 * i + float(draw.normal(0, 30)), int(130 + i + draw.integers(-1, 2)), 0.9) for m in range(5) for i in range(8)]
    got = {r.map_id: r.score for r in labels.sequence_score(spark.createDataFrame(rows, LABEL)).collect()}
    for m in got:
        mine = [r for r in rows if r[0] == m]
        assert got[m] == pytest.approx(labels._score([r[4] for r in mine], np.array([r[3] for r in mine]), labels.SPACING))
