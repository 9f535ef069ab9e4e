"""Queries over the supplied tables, one or more for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affine, buckets, names
from ..functions import labels as label_functions
from ..operators import dataset, evaluate, fit, labels, spatial
from ..sources import sinks
from .pipelines import settled
from .views import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


def q(c: Column, digits: int = 3) -> Column:
    """Rounded the same way in both engines: half up, by floor."""
    return F.floor(c * 10**digits + 0.5) / 10.0**digits


def rounded(df: DataFrame, digits: int = 3, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[q(F.col(c), digits).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def _q(sql: str, digits: int = 3) -> str:
    return f"floor(({sql}) * {10**digits} + 0.5) / {10.0**digits}"


KEY = ["map_id", "k1", "k2", "k3", "k4"]
#: A made-up reference transform for each map.
REFERENCE = {"a": "0.85e0 + map_id % 7 * 0.001e0", "b": "0.002e0", "c": "-0.001e0", "d": "-0.84e0 - map_id % 5 * 0.001e0", "e": "189000e0 + map_id", "f": "630000e0 - map_id"}


def _reference(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.expr(s).alias(n) for n, s in REFERENCE.items()])


_REF = ", ".join(f"{s} AS {n}" for n, s in REFERENCE.items())

# scalar functions


@query("p1_pixel_to_map", f"SELECT map_id, k1, k2, k3, k4, {_q('a * px + c * py + e')} AS x, {_q('b * px + d * py + f')} AS y FROM (SELECT map_id, k1, k2, k3, k4, px, py, {_REF} FROM v_obs)")
def p1(spark, sf):
    x, y = affine.pixel_to_map(F.col("px"), F.col("py"))
    return rounded(_reference(view(spark, sf, "v_obs").drop("x", "y")).select(*KEY, x.alias("x"), y.alias("y")), but=("k4",))


@query("p2_map_to_pixel", f"SELECT map_id, k1, k2, k3, k4, {_q('(d * (x - e) - c * (y - f)) / (a * d - b * c)')} AS px, {_q('(a * (y - f) - b * (x - e)) / (a * d - b * c)')} AS py FROM (SELECT map_id, k1, k2, k3, k4, x, y, {_REF} FROM v_obs)")
def p2(spark, sf):
    px, py = affine.map_to_pixel(F.col("x"), F.col("y"))
    return rounded(_reference(view(spark, sf, "v_obs").drop("px", "py")).select(*KEY, px.alias("px"), py.alias("py")), but=("k4",))


_CORNERS = [("0", "0"), ("0", "h"), ("w", "0"), ("w", "h")]


@query(
    "p3_extent",
    f"SELECT map_id, {', '.join(_q(f'{fn}(' + ', '.join(f'{m} * {px} + {k} * {py} + {o}' for px, py in _CORNERS) + ')') + f' AS {n}' for n, fn, m, k, o in (('min_x', 'least', 'a', 'c', 'e'), ('max_x', 'greatest', 'a', 'c', 'e'), ('min_y', 'least', 'b', 'd', 'f'), ('max_y', 'greatest', 'b', 'd', 'f')))} FROM (SELECT map_id, 9000e0 + map_id * 10 AS w, 12000e0 - map_id AS h, {_REF} FROM (SELECT s_suppkey AS map_id FROM supplier))",
)
def p3(spark, sf):
    maps = _reference(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("map_id")))
    return rounded(maps.select("map_id", *[c.alias(n) for n, c in affine.extent(F.expr("9000e0 + map_id * 10"), F.expr("12000e0 - map_id")).items()]))


@query(
    "p4_rescale",
    f"SELECT k, s AS scale, t AS width_scale, {', '.join(_q(f'{n} / s' if n in 'abcd' else n, 6) + f' AS {n}' for n in 'abcdef')} FROM (SELECT p_partkey AS k, p_partkey % 100 AS map_id, CASE WHEN dpi = 0 OR abs(round_even(600 / nullif(dpi, 0) * 2, 0) / 2 - 1) < 0.01 THEN 1e0 ELSE round_even(600 / dpi * 2, 0) / 2 END AS s, round_even(greatest(1e0, 14000 / (p_retailprice * 8)) * 2, 0) / 2 AS t, {_REF} FROM (SELECT *, p_partkey % 100 AS map_id, (p_size % 10) * 100e0 AS dpi FROM part))",
)
def p4(spark, sf):
    rows = _reference(table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey % 100").alias("map_id"), F.expr("(p_size % 10) * 100e0").alias("dpi"), F.expr("p_retailprice * 8").alias("w")))
    scaled = affine.rescaled(affine.dpi_scale(F.col("dpi")))
    return rows.select("k", affine.dpi_scale(F.col("dpi")).alias("scale"), affine.width_scale(F.col("w")).alias("width_scale"), *[q(c, 6).alias(n) for n, c in scaled.items()])


_SHEET = """
    SELECT k, CASE WHEN m[1] THEN g1[1] WHEN m[2] THEN least(g2[1], g2[2]) WHEN m[3] THEN g3[1] END AS lo_n,
           CASE WHEN m[1] THEN g1[1] WHEN m[2] THEN greatest(g2[1], g2[2]) WHEN m[3] THEN g3[1] END AS hi_n,
           CASE WHEN m[1] THEN g1[2] WHEN m[2] THEN g2[3] WHEN m[3] THEN least(g3[2], g3[3]) END AS lo_e,
           CASE WHEN m[1] THEN g1[2] WHEN m[2] THEN g2[3] WHEN m[3] THEN greatest(g3[2], g3[3]) END AS hi_e
    FROM (SELECT k, [regexp_matches(file_name, '^\\d{2}-\\d{2}-'), regexp_matches(file_name, '^\\d{4}-\\d{2}-'), regexp_matches(file_name, '^\\d{2}-\\d{4}-')] AS m,
                 [TRY_CAST(substr(file_name, 1, 2) AS BIGINT), TRY_CAST(substr(file_name, 4, 2) AS BIGINT)] AS g1,
                 [TRY_CAST(substr(file_name, 1, 2) AS BIGINT), TRY_CAST(substr(file_name, 3, 2) AS BIGINT), TRY_CAST(substr(file_name, 6, 2) AS BIGINT)] AS g2,
                 [TRY_CAST(substr(file_name, 1, 2) AS BIGINT), TRY_CAST(substr(file_name, 4, 2) AS BIGINT), TRY_CAST(substr(file_name, 6, 2) AS BIGINT)] AS g3
          FROM v_sheet)"""


@query("p8_sheet_parse", f"SELECT k, lo_e * 10000 + 1000000 AS old_e_min, (hi_e + 1) * 10000 + 1000000 AS old_e_max, lo_n * 10000 AS old_n_min, (hi_n + 1) * 10000 AS old_n_max FROM ({_SHEET})")
def p8(spark, sf):
    return view(spark, sf, "v_sheet").select("k", names.sheet_ranges(F.col("file_name")).alias("r")).select("k", "r.*")


@query("p9_label_ranges", f"SELECT k, lo_n * 10 - 1 AS easting_lo, (hi_n + 1) * 10 + 1 AS easting_hi, lo_e * 10 - 1 AS northing_lo, (hi_e + 1) * 10 + 1 AS northing_hi FROM ({_SHEET})")
def p9(spark, sf):
    return view(spark, sf, "v_sheet").select("k", names.label_ranges(F.col("file_name")).alias("r")).select("k", "r.*")


@query(
    "p10_conf_from_name",
    "SELECT k1, k2, k3, k4, k5, split_part(file_name, '_x', 1) AS map_id, CAST(k3 AS BIGINT) AS x, CAST(k1 AS BIGINT) AS y, CAST(regexp_extract(file_name, '_c([0-9.]+)\\.png$', 1) AS DOUBLE) AS confidence FROM v_name",
)
def p10(spark, sf):
    rows = view(spark, sf, "v_name")
    c = names.crop(F.col("file_name"))
    return rows.select("k1", "k2", "k3", "k4", "k5", c["map_id"].alias("map_id"), c["x"].alias("x"), c["y"].alias("y"), names.crop_confidence(F.col("file_name")).alias("confidence"))


@query("p12_held_out", "SELECT CASE WHEN starts_with(file_name, 'M3_') THEN 'M3' WHEN starts_with(file_name, 'M7_') THEN 'M7' END AS held_out, count(*) AS n FROM v_name GROUP BY 1")
def p12(spark, sf):
    return view(spark, sf, "v_name").groupBy(names.held_out_map(F.col("file_name"), ["M3", "M7"]).alias("held_out")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_conf_bucket", "SELECT map_id, CASE WHEN confidence / 10 * 10 >= 0.7 THEN 'high' WHEN confidence / 10 * 10 >= 0.5 THEN 'medium' ELSE 'low' END AS class, count(*) AS n FROM v_obs GROUP BY 1, 2")
def p14(spark, sf):
    return view(spark, sf, "v_obs").groupBy("map_id", buckets.confidence_class(F.expr("confidence / 10 * 10")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p15_error_status",
    "SELECT s_suppkey AS map_id, CASE WHEN e <= 7 THEN 'automatic' WHEN e <= 15 THEN 'refine' ELSE 'excessive' END AS status, CASE WHEN e < 25 THEN 'green' WHEN e < 70 THEN 'amber' ELSE 'red' END AS colour FROM (SELECT s_suppkey, abs(s_acctbal) / 100 AS e FROM supplier)",
)
def p15(spark, sf):
    e = F.abs("s_acctbal") / 100
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("map_id"), buckets.error_status(e).alias("status"), buckets.error_colour(e).alias("colour"))


_CONFUSED = ", ".join(f"('{k}', '{s}', {i})" for k, v in label_functions.CONFUSED.items() for i, s in enumerate(v))
_VARIANTS = f"""SELECT map_id, id, val, CAST(concat(substr(t, CAST(i AS INTEGER) - 0, 0), substr(t, 1, CAST(i AS INTEGER) - 1), b, substr(t, CAST(i AS INTEGER) + 1)) AS BIGINT) AS variant
    FROM (SELECT map_id, id, val, CAST(val AS VARCHAR) AS t FROM v_label), range(1, 5) r(i), (VALUES {_CONFUSED}) c(a, b, n) WHERE i <= length(t) AND substr(t, CAST(i AS INTEGER), 1) = a"""


@query("p16_digit_variants", _VARIANTS)
def p16(spark, sf):
    return view(spark, sf, "v_label").select("map_id", "id", "val", F.explode(label_functions.digit_variants(F.col("val"))).alias("variant"))


@query("p17_rescue", f"SELECT l.map_id, l.id, l.val, CASE WHEN r.n = 1 THEN r.v END AS rescued FROM v_label l LEFT JOIN (SELECT id, count(DISTINCT variant) AS n, min(variant) AS v FROM ({_VARIANTS}) WHERE variant BETWEEN 140 AND 175 GROUP BY id) r ON l.id = r.id")
def p17(spark, sf):
    return view(spark, sf, "v_label").select("map_id", "id", "val", label_functions.rescued(F.col("val"), F.lit(140), F.lit(175)).alias("rescued"))


@query("p18_zone_strip", "SELECT map_id, id, CASE WHEN v > 180 AND v % 1000 >= 60 THEN v % 1000 ELSE v END AS value FROM (SELECT map_id, id, val + 1000 * (id % 3) AS v FROM v_label)")
def p18(spark, sf):
    return view(spark, sf, "v_label").select("map_id", "id", label_functions.without_zone(F.expr("val + 1000 * (id % 3)"), F.lit(60), F.lit(180)).alias("value"))


@query(
    "p20_grid_points",
    f"SELECT map_id, axis, id, {_q('px')} AS pixel_x, {_q('py')} AS pixel_y, {_q('CASE WHEN east THEN d * py + f + 1000000 ELSE val * 1000.0e0 + 1000000 END')} AS old_e, {_q('CASE WHEN east THEN val * 1000.0e0 ELSE a * px + e END')} AS old_n "
    f"FROM (SELECT *, axis = 'easting' AS east, CASE WHEN axis = 'easting' THEN pos WHEN edge = 'left' THEN 900e0 ELSE 12000e0 END AS px, CASE WHEN axis = 'easting' THEN CASE WHEN edge = 'top' THEN 800e0 ELSE 11000e0 END ELSE pos END AS py, {_REF} FROM (SELECT map_id, id, pos, val, CASE WHEN id % 3 = 0 THEN 'easting' ELSE 'northing' END AS axis, CASE WHEN id % 5 = 0 THEN 'top' ELSE edge END AS edge FROM v_label))",
)
def p20(spark, sf):
    rows = view(spark, sf, "v_label").select("map_id", "id", "pos", "val", F.expr("CASE WHEN id % 3 = 0 THEN 'easting' ELSE 'northing' END").alias("axis"), F.expr("CASE WHEN id % 5 = 0 THEN 'top' ELSE edge END").alias("edge"))
    maps = rows.select("map_id").distinct()
    lines = maps.select("map_id", F.lit(800).alias("top"), F.lit(11000).alias("bottom"), F.lit(900).alias("left"), F.lit(12000).alias("right"))
    return rounded(labels.grid_points(rows, _reference(maps), lines))


_DRIFT = "greatest(" + ", ".join(f"sqrt(power(a * {px} + c * {py} + e - (a2 * {px} + c * {py} + e + 3), 2) + power(b * {px} + d * {py} + f - (b * {px} + d2 * {py} + f - 4), 2))" for px, py in (("0", "0"), ("0", "9000e0"), ("12000e0", "0"), ("12000e0", "9000e0"))) + ")"


@query(
    "p21_corner_drift",
    f"SELECT map_id, {_q(_DRIFT)} AS drift, {_q('sqrt(power((a + d) / 2, 2) + power((b - c) / 2, 2)) + sqrt(power((a - d) / 2, 2) + power((b + c) / 2, 2))', 6)} AS size_1, {_q('abs(sqrt(power((a + d) / 2, 2) + power((b - c) / 2, 2)) - sqrt(power((a - d) / 2, 2) + power((b + c) / 2, 2)))', 6)} AS size_2 FROM (SELECT *, a * 1.001e0 AS a2, d * 0.999e0 AS d2 FROM (SELECT map_id, {_REF} FROM (SELECT s_suppkey AS map_id FROM supplier)))",
)
def p21(spark, sf):
    maps = _reference(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("map_id")))
    t = affine.columns()
    other = t | {"a": t["a"] * 1.001, "d": t["d"] * 0.999, "e": t["e"] + 3, "f": t["f"] - 4}
    one, two = affine.pixel_sizes()
    return maps.select("map_id", q(affine.corner_drift(t, other, F.lit(12000.0), F.lit(9000.0))).alias("drift"), q(one, 6).alias("size_1"), q(two, 6).alias("size_2"))


@query("p24_gcp_frames", f"SELECT map_id, frame, {_q('sum(px)', 2)} AS sum_px, {_q('sum(py)', 2)} AS sum_py, count(*) AS n FROM (SELECT map_id, 'up' AS frame, px / 600 * 300 AS px, 9000 - py / 600 * 300 AS py FROM v_obs UNION ALL SELECT map_id, 'down', px / 600 * 300, py / 600 * 300 FROM v_obs) GROUP BY 1, 2")
def p24(spark, sf):
    frames = affine.inch_frames(F.col("px") / 600, F.col("py") / 600, F.lit(300), F.lit(9000))
    return view(spark, sf, "v_obs").select("map_id", F.inline(frames)).groupBy("map_id", "frame").agg(q(F.sum("px"), 2).alias("sum_px"), q(F.sum("py"), 2).alias("sum_py"), F.count(F.lit(1)).alias("n"))


_READY = "CASE WHEN k % 11 = 0 THEN 'waiting for image' WHEN k % 3 = 0 AND k % 5 = 0 THEN 'waiting for transform' WHEN coalesce(pts, gcps, 0) = 0 THEN 'waiting for control points' WHEN k % 13 = 0 THEN 'already ingested' ELSE 'ready' END"


@query("p27_readiness", f"SELECT status, count(*) AS n FROM (SELECT {_READY} AS status FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 7 END AS gcps, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 9 END AS pts FROM customer)) GROUP BY 1")
def p27(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 7 END AS gcps", "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 9 END AS pts")
    status = buckets.readiness(F.expr("CASE WHEN k % 11 = 0 THEN NULL ELSE 'i' END"), F.expr("CASE WHEN k % 3 = 0 THEN NULL ELSE 'w' END"), F.col("gcps"), F.col("pts"), F.expr("k % 13 = 0"))
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# filters


@query("f1_in_frame", "SELECT map_id, count(*) AS n, sum(CASE WHEN rint_x - 32 >= 0 AND rint_y - 32 >= 0 AND rint_x + 32 < 12000 AND rint_y + 32 < 9000 THEN 1 ELSE 0 END)::BIGINT AS inside FROM (SELECT map_id, round_even(px + 0.5, 0) AS rint_x, round_even(py, 0) AS rint_y FROM v_obs) GROUP BY 1")
def f1(spark, sf):
    inside = spatial.in_frame(F.col("px") + 0.5, F.col("py"), F.lit(32), F.lit(12000), F.lit(9000))
    return view(spark, sf, "v_obs").groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"))


@query(
    "f3_in_bounds",
    "SELECT map_id, count(*) AS n FROM v_obs WHERE CASE WHEN map_id % 3 = 0 THEN px BETWEEN 985 AND 9015 AND py BETWEEN 985 AND 8015 WHEN map_id % 3 = 1 THEN px BETWEEN 870 AND 9130 AND py BETWEEN 870 AND 8130 ELSE TRUE END GROUP BY 1",
)
def f3(spark, sf):
    def box(lo: int, right: int, bottom: int) -> Column:
        return F.struct(F.lit(lo).alias("top"), F.lit(bottom).alias("bottom"), F.lit(lo).alias("left"), F.lit(right).alias("right"))

    grid, line = F.when(F.col("map_id") % 3 == 0, box(1000, 9000, 8000)), F.when(F.col("map_id") % 3 == 1, box(900, 9100, 8100))
    return view(spark, sf, "v_obs").filter(spatial.in_grid_or_neatline(F.col("px"), F.col("py"), grid, line)).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


# joins

_BOX = "FROM v_geo g JOIN v_extent e ON {x} BETWEEN e.min_x - {m} AND e.max_x + {m} AND {y} BETWEEN e.min_y - {m} AND e.max_y + {m}"


@query("j1_range_join", "SELECT e.map_id, g.pid " + _BOX.format(x="g.easting", y="g.northing", m=200))
def j1(spark, sf):
    boxes = view(spark, sf, "v_extent")
    return spatial.box_join(view(spark, sf, "v_geo"), boxes, "easting", "northing", 200, bin_size=spatial.box_side(boxes, 200)).select("map_id", "pid")


@query("j1_range_join_binned", "SELECT e.map_id, g.pid " + _BOX.format(x="g.easting", y="g.northing", m=200))
def j1b(spark, sf):
    return spatial.box_join(view(spark, sf, "v_geo"), view(spark, sf, "v_extent"), "easting", "northing", 200, bin_size=4000).select("map_id", "pid")


@query("j2_old_grid_join", "SELECT e.map_id, g.pid FROM v_geo g JOIN v_extent e ON g.old_n BETWEEN e.min_x - 50000 - 1000 AND e.max_x - 50000 + 1000 AND g.old_e BETWEEN e.min_y + 500000 - 1000 AND e.max_y + 500000 + 1000")
def j2(spark, sf):
    boxes = view(spark, sf, "v_extent").selectExpr("map_id", "min_x - 50000 AS min_x", "max_x - 50000 AS max_x", "min_y + 500000 AS min_y", "max_y + 500000 AS max_y")
    return spatial.box_join(view(spark, sf, "v_geo"), boxes, "old_n", "old_e", 1000, bin_size=5000).select("map_id", "pid")


def _detections(spark, sf) -> DataFrame:
    rows = view(spark, sf, "v_obs")
    return spatial.top_of_each(rows, [F.desc("confidence"), "k1", "k2", "k3", "k4"], None).withColumnRenamed("rank", "det")


_DET = "SELECT map_id, px, py, row_number() OVER (PARTITION BY map_id ORDER BY confidence DESC, k1, k2, k3, k4) AS det FROM v_obs"
_NEAR = f"SELECT map_id, det, arg_min(gt, [distance, gt]) AS gt, min(distance) AS distance FROM (SELECT d.map_id, d.det, t.gt, sqrt(power(d.px - t.qx, 2) + power(d.py - t.qy, 2)) AS distance FROM ({_DET}) d JOIN v_truth t ON d.map_id = t.map_id) WHERE distance < 300 GROUP BY 1, 2"


@query("j3_nearest_match", f"SELECT map_id, min(det) AS det, gt, count(*) AS n FROM ({_NEAR}) GROUP BY map_id, gt")
def j3(spark, sf):
    det, truth = _detections(spark, sf).select("map_id", "det", "px", "py"), view(spark, sf, "v_truth").select("map_id", "gt", "qx", "qy")
    near = spatial.match_nearest(det, truth, 300.0, one_to_one=False)
    first = spatial.match_nearest(det, truth, 300.0)
    return first.select("map_id", "det", "gt").join(near.groupBy("map_id", "gt").agg(F.count(F.lit(1)).alias("n")), ["map_id", "gt"]).select("map_id", "det", "gt", "n")


@query("j5_semi_radius", "SELECT map_id, count(*) AS n FROM v_obs o WHERE EXISTS (SELECT 1 FROM v_truth t WHERE t.map_id = o.map_id AND sqrt(power(o.px - t.qx, 2) + power(o.py - t.qy, 2)) < 100) GROUP BY 1")
def j5(spark, sf):
    rows = _detections(spark, sf).withColumn("id", F.col("det"))
    return spatial.near_any(rows, view(spark, sf, "v_truth"), 100.0).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


@query("j7_proximity_anti", "SELECT map_id, count(*) AS n FROM v_obs o WHERE NOT EXISTS (SELECT 1 FROM v_truth t WHERE t.map_id = o.map_id AND sqrt(power(o.px - t.qx, 2) + power(o.py - t.qy, 2)) <= 200) GROUP BY 1")
def j7(spark, sf):
    rows = _detections(spark, sf).withColumn("id", F.col("det"))
    return spatial.near_any(rows, view(spark, sf, "v_truth"), 200.0, anti=True, strict=False).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


_READ = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('Customer#', lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) ELSE 'unread' END AS name, floor(abs(s_acctbal)) + 0.5e0 AS height FROM supplier"


@query(
    "j6_name_or_height",
    f"WITH r AS ({_READ}), n AS (SELECT name, max(pid) AS pid FROM v_geo GROUP BY 1), a AS (SELECT r.id, n.pid FROM r JOIN n ON r.name = n.name) "
    "SELECT id, pid, 'name' AS matched_by FROM a UNION ALL SELECT r.id, max(g.pid), 'height' FROM r JOIN v_geo g ON abs(round_even(r.height * 10, 0) - round_even(g.height * 10, 0)) <= 10 WHERE r.id NOT IN (SELECT id FROM a) GROUP BY r.id HAVING count(DISTINCT g.name) = 1",
)
def j6(spark, sf):
    read = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN concat('Customer#', lpad(cast(s_suppkey AS string), 9, '0')) ELSE 'unread' END AS name", "floor(abs(s_acctbal)) + 0.5e0 AS height")
    return spatial.match_by_name_or_height(read, view(spark, sf, "v_geo"))


@query("j8_round_robin", "SELECT map_id, pid, turn FROM (SELECT e.map_id, g.pid, row_number() OVER (PARTITION BY e.map_id ORDER BY g.pid) AS turn " + _BOX.format(x="g.easting", y="g.northing", m=200) + ") ORDER BY turn, map_id LIMIT 60")
def j8(spark, sf):
    return spatial.round_robin(j1b(spark, sf), ["pid"], 60).withColumn("turn", F.col("turn").cast("long"))


_PAIRS = "SELECT a.map_id, a.axis, a.id AS id_i, b.id AS id_j, (b.pos - a.pos) / nullif(b.val - a.val, 0) AS rate FROM v_label a JOIN v_label b ON a.map_id = b.map_id AND a.axis = b.axis AND a.id < b.id"


@query("j10_pair_rates", f"SELECT map_id, axis, id_i, id_j, {_q('rate')} AS rate FROM ({_PAIRS}) WHERE abs(rate) BETWEEN 500 AND 2500")
def j10(spark, sf):
    return rounded(labels.pair_rates(view(spark, sf, "v_label")).select("map_id", "axis", "id_i", "id_j", "rate"))


@query(
    "j12_anti",
    "SELECT folder, count(*) AS n FROM (SELECT c_custkey AS k, 'negative' AS folder FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'hard_negative' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)) WHERE k NOT IN (SELECT s_suppkey FROM supplier) AND k NOT IN (SELECT p_partkey FROM part) GROUP BY 1",
)
def j12(spark, sf):
    def keys(t: str, c: str) -> DataFrame:
        return table(spark, sf, t).select(F.col(c).alias("file_name"))

    return dataset.without_rescued(keys("customer", "c_custkey").filter("file_name % 3 <> 0"), keys("orders", "o_orderkey"), keys("supplier", "s_suppkey"), keys("part", "p_partkey")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


# fits

_MOMENTS = "count(*) AS n, avg(px) AS mx, avg(py) AS my, avg(x) AS mu, avg(y) AS mv, var_pop(px) AS sxx, var_pop(py) AS syy, covar_pop(px, py) AS sxy, covar_pop(px, x) AS ux, covar_pop(py, x) AS uy, covar_pop(px, y) AS vx, covar_pop(py, y) AS vy"


def _fit_sql(rows: str) -> str:
    """A transform for each map of ``rows`` (map_id, px, py, x, y)."""
    return f"""SELECT map_id, n, a, b, c, d, mu - a * mx - c * my AS e, mv - b * mx - d * my AS f FROM (
        SELECT *, (ux * syy - uy * sxy) / det AS a, (uy * sxx - ux * sxy) / det AS c, (vx * syy - vy * sxy) / det AS b, (vy * sxx - vx * sxy) / det AS d
        FROM (SELECT *, sxx * syy - sxy * sxy AS det FROM (SELECT map_id, {_MOMENTS} FROM {rows} GROUP BY map_id)) WHERE n >= 3 AND det > 1e-12 * sxx * syy AND det > 0)"""


_ERR = "sqrt(power(o.x - (t.a * o.px + t.c * o.py + t.e), 2) + power(o.y - (t.b * o.px + t.d * o.py + t.f), 2))"
_SHOW = ", ".join(f"{_q(n, 6 if n in 'abcd' else 3)} AS {n}" for n in affine.NAMES)
_RMSE = f"{_q('sqrt(avg(err * err) / 2)')} AS rmse_component_m, {_q('sqrt(avg(err * err))')} AS rmse_radial_m, {_q('max(err)')} AS max_error_m"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[q(F.col(c), 6 if c in "abcd" else 3).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("a1_affine_fit", f"WITH t AS ({_fit_sql('v_obs')}), r AS (SELECT map_id, {_RMSE} FROM (SELECT o.map_id, {_ERR} AS err FROM v_obs o JOIN t ON o.map_id = t.map_id) GROUP BY 1) SELECT t.map_id, {_SHOW}, n, rmse_component_m, rmse_radial_m, max_error_m FROM t JOIN r ON t.map_id = r.map_id")
def a1(spark, sf):
    return _shown(fit.fit_affine(view(spark, sf, "v_obs")))


def _trim_sql(kind: str) -> str:
    return f"""WITH t AS ({_fit_sql('v_obs')}), r AS (SELECT o.*, {_ERR} AS err FROM v_obs o JOIN t ON o.map_id = t.map_id),
        s AS (SELECT map_id, greatest(15, 2 * sqrt(avg(err * err) / {kind})) AS lim, count(*) AS n FROM r GROUP BY 1),
        k AS (SELECT r.* FROM r JOIN s ON r.map_id = s.map_id WHERE err < lim),
        i AS (SELECT s.map_id, s.n, count(k.map_id) AS n_in FROM s LEFT JOIN k ON s.map_id = k.map_id GROUP BY 1, 2),
        z AS (SELECT * FROM v_obs o WHERE map_id IN (SELECT map_id FROM i WHERE NOT (n_in >= 3 AND n_in < n)) UNION ALL SELECT map_id, k1, k2, k3, k4, px, py, confidence, x, y FROM k WHERE map_id IN (SELECT map_id FROM i WHERE n_in >= 3 AND n_in < n)),
        u AS ({_fit_sql('z')}), w AS (SELECT map_id, {_RMSE} FROM (SELECT o.map_id, {_ERR.replace('t.', 'u.')} AS err FROM z o JOIN u ON o.map_id = u.map_id) GROUP BY 1)
        SELECT u.map_id, {_SHOW}, i.n, CASE WHEN i.n_in < 3 THEN i.n ELSE i.n_in END AS n_inliers, rmse_component_m, rmse_radial_m, max_error_m FROM u JOIN w ON u.map_id = w.map_id JOIN i ON u.map_id = i.map_id"""


@query("a5_trim_refit", _trim_sql("1"))
def a5(spark, sf):
    return _shown(fit.trim_and_refit(view(spark, sf, "v_obs")))


@query("a6_trim_refit_component", _trim_sql("2"))
def a6(spark, sf):
    return _shown(fit.trim_and_refit(view(spark, sf, "v_obs"), rmse="rmse_component_m"))


@query("a3_polynomial")
def a3(spark, sf):
    got = fit.fit_polynomial(view(spark, sf, "v_obs").select("map_id", "px", "py", "x", "y"))
    return got.select("map_id", "n", q(F.col("rmse_component_m")).alias("rmse_component_m"), F.transform("cx", lambda v: q(v, 4)).alias("cx"), F.transform("cy", lambda v: q(v, 4)).alias("cy"))


_SPREAD = """SELECT map_id, unnest(range(1, len(kept) + 1)) AS pick, unnest(kept) AS k FROM (
    SELECT map_id, list_reduce(rows, lambda acc, r: CASE WHEN len(acc) >= {n} OR len(list_filter(acc, lambda s: sqrt(power(s.px - r[1].px, 2) + power(s.py - r[1].py, 2)) < {d})) > 0 THEN acc ELSE list_concat(acc, r) END) AS kept
    FROM (SELECT map_id, list([{{'px': px, 'py': py, 'k1': k1, 'k2': k2, 'k3': k3, 'k4': k4, 'x': x, 'y': y}}] ORDER BY confidence DESC, k1, k2, k3, k4) AS rows FROM v_obs WHERE confidence >= 0.5 GROUP BY map_id))"""
_PICKS = "SELECT map_id, pick AS id, k.px AS px, k.py AS py, k.x AS x, k.y AS y, k.k1 AS k1, k.k2 AS k2, k.k3 AS k3, k.k4 AS k4 FROM (" + _SPREAD.format(n=15, d="200") + ")"


def _picked(spark, sf, carry: tuple[str, ...] = ("px", "py", "x", "y"), n: int | None = 15, distance: float = 200.0) -> DataFrame:
    rows = view(spark, sf, "v_obs").filter("confidence >= 0.5").withColumn("down", -F.col("confidence"))
    return spatial.select_spread(rows, ["down", "k1", "k2", "k3", "k4"], list(carry), n, distance)


@query("t2_greedy_select", f"SELECT map_id, CAST(id AS INTEGER) AS pick, k1, k2, k3, k4 FROM ({_PICKS})")
def t2(spark, sf):
    return _picked(spark, sf, ("k1", "k2", "k3", "k4"))


@query("t3_grid_nms", "SELECT map_id, CAST(pick AS INTEGER) AS pick, k.k1 AS k1, k.k2 AS k2, k.k3 AS k3, k.k4 AS k4 FROM (" + _SPREAD.format(n=1000000, d="1000") + ")")
def t3(spark, sf):
    rows = view(spark, sf, "v_obs").filter("confidence >= 0.5").withColumn("down", -F.col("confidence"))
    return spatial.suppress(rows, ["down", "k1", "k2", "k3", "k4"], ["k1", "k2", "k3", "k4"], 1000.0)


_TRIPLE = """SELECT i.map_id, i.id AS i, j.id AS j, k.id AS k, {cols} FROM p i JOIN p j ON i.map_id = j.map_id AND i.id < j.id JOIN p k ON i.map_id = k.map_id AND j.id < k.id
    WHERE (j.px - i.px) * (k.py - i.py) - (k.px - i.px) * (j.py - i.py) <> 0"""
_DET3 = "((j.px - i.px) * (k.py - i.py) - (k.px - i.px) * (j.py - i.py))"
_T3 = ", ".join(
    f"((j.{c} - i.{c}) * (k.py - i.py) - (k.{c} - i.{c}) * (j.py - i.py)) / {_DET3} AS {m}, ((k.{c} - i.{c}) * (j.px - i.px) - (j.{c} - i.{c}) * (k.px - i.px)) / {_DET3} AS {n}" for c, m, n in (("x", "a", "c"), ("y", "b", "d"))
) + ", i.px AS ipx, i.py AS ipy, i.x AS ix, i.y AS iy"


@query(
    "a4_ransac",
    f"WITH p AS ({_PICKS}), t0 AS ({_TRIPLE.format(cols=_T3)}), t AS (SELECT *, ix - a * ipx - c * ipy AS e, iy - b * ipx - d * ipy AS f FROM t0), "
    f"s AS (SELECT t.map_id, t.i, t.j, t.k, sum(CASE WHEN {_ERR} < 5 THEN 1 ELSE 0 END) AS n FROM t JOIN p o ON o.map_id = t.map_id GROUP BY 1, 2, 3, 4), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY n DESC, i, j, k) AS r FROM s WHERE n >= 5) WHERE r = 1) "
    f"SELECT o.map_id, count(*) AS n_inliers, sum(o.id)::BIGINT AS ids FROM best JOIN t ON t.map_id = best.map_id AND t.i = best.i AND t.j = best.j AND t.k = best.k JOIN p o ON o.map_id = t.map_id WHERE {_ERR} < 5 GROUP BY 1",
)
def a4(spark, sf):
    picks = settled(_picked(spark, sf).withColumnRenamed("pick", "id"))
    return fit.consensus_affine(picks, threshold=5.0).groupBy("map_id").agg(F.count(F.lit(1)).alias("n_inliers"), F.sum("id").alias("ids"))


# labels


@query("a7_mad_line")
def a7(spark, sf):
    got = labels.fit_lines(labels.consensus(view(spark, sf, "v_label").drop("edge")))
    return got.groupBy("map_id", "axis").agg(F.count(F.lit(1)).alias("n"), q(F.first("slope") * 1000, 6).alias("m_per_px"), q(F.first("offset")).alias("offset_km"))


_LINE = f"""l AS (SELECT p.*, a.pos - p.rate * a.val AS b FROM ({_PAIRS}) p JOIN v_label a ON a.id = p.id_i AND a.map_id = p.map_id WHERE abs(rate) BETWEEN 500 AND 2500),
    h AS (SELECT l.map_id, l.axis, id_i, id_j, rate, b, count(*) AS n, sum(abs(v.pos - (rate * v.val + b))) AS s FROM l JOIN v_label v ON v.map_id = l.map_id AND v.axis = l.axis WHERE abs(v.pos - (rate * v.val + b)) <= 0.25 * abs(rate) GROUP BY 1, 2, 3, 4, 5, 6),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id, axis ORDER BY n DESC, s, id_i, id_j) AS r FROM h WHERE n >= 3) WHERE r = 1)"""


@query("a8_consensus", f"WITH {_LINE} SELECT v.map_id, v.axis, count(*) AS n, sum(v.id)::BIGINT AS ids, min(v.val) AS lo, max(v.val) AS hi FROM v_label v JOIN k ON v.map_id = k.map_id AND v.axis = k.axis WHERE abs(v.pos - (rate * v.val + b)) <= 0.25 * abs(rate) GROUP BY 1, 2")
def a8(spark, sf):
    return labels.consensus(view(spark, sf, "v_label").drop("edge")).groupBy("map_id", "axis").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.min("val").alias("lo"), F.max("val").alias("hi"))


@query("a9_monotonic")
def a9(spark, sf):
    return labels.remove_non_monotonic(view(spark, sf, "v_label").drop("edge")).groupBy("map_id", "axis").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("a10_validate", f"WITH m AS (SELECT map_id, axis, median(rate) AS rate FROM ({_PAIRS}) WHERE abs(rate) BETWEEN 500 AND 2500 GROUP BY 1, 2) SELECT i.map_id, i.axis, count(DISTINCT i.id) AS n, sum(DISTINCT i.id)::BIGINT AS ids FROM v_label i JOIN v_label j ON i.map_id = j.map_id AND i.axis = j.axis AND i.id <> j.id AND i.val <> j.val JOIN m ON m.map_id = i.map_id AND m.axis = i.axis WHERE abs((j.pos - i.pos) - (j.val - i.val) * rate) / abs((j.val - i.val) * rate) < 0.30 GROUP BY 1, 2")
def a10(spark, sf):
    return labels.validate_sequence(view(spark, sf, "v_label").drop("edge")).groupBy("map_id", "axis").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("a11_digit_fix")
def a11(spark, sf):
    return labels.repair_digits(view(spark, sf, "v_label").drop("edge")).groupBy("map_id", "axis").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("vals"), q(F.sum("conf")).alias("conf"))


@query(
    "a12_sequence_score",
    "WITH s AS (SELECT *, val - lag(val) OVER w AS dv, pos - lag(pos) OVER w AS dp FROM v_label WINDOW w AS (PARTITION BY map_id, axis ORDER BY id)), r AS (SELECT *, CASE WHEN abs(dp / nullif(dv, 0)) BETWEEN 500 AND 2500 THEN abs(dp / nullif(dv, 0)) END AS r FROM s) "
    "SELECT map_id, axis, count(r) + 0.5e0 * count(CASE WHEN r IS NOT NULL AND abs(dv) = 1 THEN 1 END) + CASE WHEN count(r) >= 2 AND stddev_pop(r) / avg(r) < 0.1 THEN 2.0e0 WHEN count(r) >= 2 AND stddev_pop(r) / avg(r) < 0.2 THEN 1.0e0 ELSE 0.0e0 END AS score FROM r GROUP BY 1, 2",
)
def a12(spark, sf):
    return labels.sequence_score(view(spark, sf, "v_label")).select("map_id", "axis", F.col("score").cast("double").alias("score"))


@query(
    "a13_merge_edges",
    f"SELECT map_id, axis, val, {_q('CASE WHEN torn THEN best.pos ELSE p END')} AS pos, CASE WHEN torn THEN best.conf ELSE c END AS conf, CASE WHEN torn THEN best.edge WHEN n = 1 THEN e ELSE 'both' END AS edge FROM (SELECT map_id, axis, val, max(pos) - min(pos) > 150 AS torn, arg_max({{'pos': pos, 'conf': conf, 'edge': edge}}, [conf, -id]) AS best, avg(pos) AS p, max(conf) AS c, min(edge) AS e, count(*) AS n FROM v_label GROUP BY 1, 2, 3)",
)
def a13(spark, sf):
    return labels.merge_edges(view(spark, sf, "v_label")).withColumn("pos", q(F.col("pos")))


@query("a14_label_extent", "SELECT map_id, min(CASE WHEN axis = 'northing' THEN val * 1000.0e0 + 1000000 END) - 1000 AS old_e_min, max(CASE WHEN axis = 'northing' THEN val * 1000.0e0 + 1000000 END) + 1000 AS old_e_max, min(CASE WHEN axis = 'easting' THEN val * 1000.0e0 END) - 1000 AS old_n_min, max(CASE WHEN axis = 'easting' THEN val * 1000.0e0 END) + 1000 AS old_n_max FROM (SELECT map_id, val, CASE WHEN id % 3 = 0 THEN 'easting' ELSE axis END AS axis FROM v_label) GROUP BY 1")
def a14(spark, sf):
    return labels.label_extent(view(spark, sf, "v_label").withColumn("axis", F.expr("CASE WHEN id % 3 = 0 THEN 'easting' ELSE axis END")))


@query("w1_cluster_lines", "WITH p AS (SELECT l_suppkey AS map_id, CAST(l_partkey % 2000 AS INTEGER) AS pos FROM lineitem), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY map_id ORDER BY pos) > 3 THEN 1 ELSE 0 END AS new FROM p), c AS (SELECT *, sum(new) OVER (PARTITION BY map_id ORDER BY pos RANGE UNBOUNDED PRECEDING) AS c FROM g) SELECT map_id, CAST(floor(avg(pos)) AS INTEGER) AS line FROM c GROUP BY map_id, c")
def w1(spark, sf):
    return labels.cluster_lines(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("map_id"), F.expr("cast(l_partkey % 2000 as int)").alias("pos")))


_LINES = "SELECT map_id, CAST(floor(pos / 10) AS BIGINT) AS line FROM (SELECT DISTINCT map_id, pos FROM v_label WHERE conf > 0.5)"


@query(
    "w2_regular_grid",
    f"""WITH l AS (SELECT map_id, list(DISTINCT line ORDER BY line) AS l FROM ({_LINES}) GROUP BY 1), d AS (SELECT *, (SELECT median(l[i + 1] - l[i]) FROM range(1, len(l)) r(i)) AS m FROM l),
    g AS (SELECT *, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] BETWEEN 0.5 * m AND 1.5 * m OR (x[1] - acc[-1] > 1.5 * m AND abs((x[1] - acc[-1]) / greatest(round_even((x[1] - acc[-1]) / m, 0), 1) - m) / m < 0.3) THEN list_concat(acc, x) ELSE acc END) AS g FROM d)
    SELECT map_id, unnest(CASE WHEN len(l) >= 3 AND m >= 50 AND len(g) >= 3 THEN g ELSE l END) AS line FROM g""",
)
def w2(spark, sf):
    lines = view(spark, sf, "v_label").filter("conf > 0.5").select("map_id", F.floor(F.col("pos") / 10).alias("line")).distinct()
    return labels.regular_lines(lines)


@query(
    "w4_ocr_dedupe",
    """SELECT map_id, edge, unnest(kept).id AS id FROM (SELECT map_id, edge, list_reduce(rows, lambda acc, r: CASE WHEN abs(r[1].pos - acc[-1].pos) < 50 THEN CASE WHEN r[1].conf > acc[-1].conf THEN list_concat(acc[:len(acc) - 1], r) ELSE acc END ELSE list_concat(acc, r) END) AS kept
    FROM (SELECT map_id, edge, list([{'pos': pos, 'id': id, 'conf': conf}] ORDER BY pos, id) AS rows FROM v_label GROUP BY 1, 2))""",
)
def w4(spark, sf):
    return labels.dedupe_readings(view(spark, sf, "v_label")).select("map_id", "edge", "id")


@query("t9_mode_groups", "SELECT map_id, axis, decade, n AS count, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY map_id, axis ORDER BY n DESC, f) AS r FROM (SELECT map_id, axis, CAST(floor(val / 10.0) AS BIGINT) AS decade, count(*) AS n, min(id) AS f FROM v_label GROUP BY 1, 2, 3)) WHERE r <= 2")
def t9(spark, sf):
    return labels.decade_modes(view(spark, sf, "v_label"))


# evaluation

_TRUTH = "SELECT map_id, enable, qx AS px, qy AS py, 0.85e0 * qx - 0.001e0 * qy + 189000 + gt % 11 AS x, 0.002e0 * qx - 0.84e0 * qy + 630000 - gt % 7 AS y FROM v_truth"


def _world(spark, sf) -> DataFrame:
    return view(spark, sf, "v_truth").selectExpr("map_id", "enable", "qx AS px", "qy AS py", "0.85e0 * qx - 0.001e0 * qy + 189000 + gt % 11 AS x", "0.002e0 * qx - 0.84e0 * qy + 630000 - gt % 7 AS y")


@query("a15_eval_transform", f"WITH t AS ({_fit_sql('v_obs')}), e AS (SELECT t.map_id, {_ERR} AS err FROM t JOIN ({_TRUTH}) o ON o.map_id = t.map_id AND enable = 1) SELECT t.map_id, count(err) AS n, coalesce({_q('avg(err)')}, 'NaN') AS mean_m, coalesce({_q('max(err)')}, 'NaN') AS max_m, coalesce({_q('sqrt(avg(err * err))')}, 'NaN') AS rmse_radial_m, coalesce({_q('median(err)')}, 'NaN') AS median_m FROM t LEFT JOIN e ON t.map_id = e.map_id GROUP BY 1")
def a15(spark, sf):
    got = evaluate.transform_error(_world(spark, sf), fit.fit_affine(view(spark, sf, "v_obs")))
    return got.select("map_id", "n", *[F.when(F.isnan(c), F.col(c)).otherwise(q(F.col(c))).alias(c) for c in ("mean_m", "max_m", "rmse_radial_m", "median_m")])


@query(
    "a16_pr_totals",
    f"WITH m AS (SELECT map_id, gt, arg_min(distance, det) AS distance FROM ({_NEAR}) GROUP BY 1, 2), r AS (SELECT map_id, 1 AS d, 0 AS t, 0 AS m, NULL AS distance FROM v_obs UNION ALL SELECT map_id, 0, 1, 0, NULL FROM v_truth UNION ALL SELECT map_id, 0, 0, 1, distance FROM m) "
    f"SELECT map_id, grouping(map_id) = 1 AS is_total, sum(d)::BIGINT AS detections, sum(t)::BIGINT AS truths, sum(m)::BIGINT AS matches, {_q('coalesce(sum(m) / nullif(sum(d), 0), 0)', 6)} AS precision, {_q('coalesce(sum(m) / nullif(sum(t), 0), 0)', 6)} AS recall, {_q('avg(distance)')} AS mean_px FROM r GROUP BY GROUPING SETS ((map_id), ())",
)
def a16(spark, sf):
    det, truth = _detections(spark, sf).select("map_id", "det", "px", "py"), view(spark, sf, "v_truth")
    got = evaluate.detection_report(det, truth, spatial.match_nearest(det, truth.select("map_id", "gt", "qx", "qy"), 300.0))
    return got.withColumns({"precision": q(F.col("precision"), 6), "recall": q(F.col("recall"), 6), "mean_px": q(F.col("mean_px"))})


_CONF = "sum(CASE WHEN prob >= 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN prob >= 0.5 AND label <> 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN prob < 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN prob < 0.5 AND label <> 1 THEN 1 ELSE 0 END)::BIGINT AS tn"


@query(
    "a18_confusion",
    f"SELECT source, tp, fp, fn, tn, is_total, {_q('p', 6)} AS precision, {_q('r', 6)} AS recall, {_q('2 * p * r / greatest(p + r, 1e-9)', 6)} AS f1, {_q('(tp + tn) / greatest(tp + fp + fn + tn, 1)', 6)} AS accuracy FROM (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM (SELECT source, {_CONF}, grouping(source) = 1 AS is_total FROM v_scored GROUP BY GROUPING SETS ((source), ())))",
)
def a18(spark, sf):
    return rounded(evaluate.confusion(view(spark, sf, "v_scored"), by="source"), 6)


_GRADE = "SELECT t.map_id, n, mean_m, median_m, max_m, drift FROM t"


@query(
    "a20_grade",
    f"WITH t AS ({_fit_sql('v_obs')}), g AS (SELECT map_id, x, y, (rd * (x - re) - rc * (y - rf)) / (ra * rd - rb * rc) AS px, (ra * (y - rf) - rb * (x - re)) / (ra * rd - rb * rc) AS py FROM (SELECT map_id, x, y, {', '.join(f'{s} AS r{n}' for n, s in REFERENCE.items())} FROM ({_TRUTH}))), "
    f"e AS (SELECT o.map_id, {_ERR} AS err FROM g o JOIN t ON o.map_id = t.map_id WHERE o.px >= 0 AND o.py >= 0 AND o.px < 14000 AND o.py < 9000) SELECT map_id, count(*) AS n, {_q('avg(err)', 2)} AS mean_m, {_q('median(err)', 2)} AS median_m, {_q('max(err)', 2)} AS max_m FROM e GROUP BY 1",
)
def a20(spark, sf):
    fitted = fit.fit_affine(view(spark, sf, "v_obs"))
    maps = view(spark, sf, "v_truth").select("map_id").distinct()
    got = evaluate.blind_grade(_world(spark, sf), fitted, _reference(maps), maps.select("map_id", F.lit(14000).alias("width"), F.lit(9000).alias("height")))
    return rounded(got.filter("status = 'ok' AND n IS NOT NULL").select("map_id", "n", "mean_m", "median_m", "max_m"), 2)


@query("a22_run_summary", f"WITH t AS ({_fit_sql('v_obs')}), r AS (SELECT map_id, sqrt(avg(err * err)) AS rmse, max(err) AS m, count(*) AS n FROM (SELECT o.map_id, {_ERR} AS err FROM v_obs o JOIN t ON o.map_id = t.map_id) GROUP BY 1) SELECT count(*) AS maps, {_q('median(rmse)')} AS median_rmse_m, {_q('avg(rmse)')} AS mean_rmse_m, {_q('median(m)')} AS median_max_m, {_q('avg(n)')} AS mean_points FROM r")
def a22(spark, sf):
    return rounded(evaluate.run_summary(fit.fit_affine(view(spark, sf, "v_obs"))))


# top-k, sets, data sets


@query("t4_topk", "SELECT map_id, k1, k2, k3, k4, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY confidence DESC, k1, k2, k3, k4) AS rank FROM v_obs) WHERE rank <= 10")
def t4(spark, sf):
    return spatial.top_of_each(view(spark, sf, "v_obs"), [F.desc("confidence"), "k1", "k2", "k3", "k4"], 10).select(*KEY, "rank")


@query("o1_union", "SELECT map_id, id, count(*) AS n FROM (SELECT map_id, id FROM v_label UNION ALL SELECT map_id, id FROM v_label WHERE conf > 0.5) GROUP BY 1, 2")
def o1(spark, sf):
    rows = view(spark, sf, "v_label").select("map_id", "id", "conf")
    return rows.unionByName(rows.filter("conf > 0.5")).groupBy("map_id", "id").agg(F.count(F.lit(1)).alias("n"))


@query("o3_except", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier UNION SELECT n_nationkey FROM nation)")
def o3(spark, sf):
    gone = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).union(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"))).distinct()
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(gone, "k", "left_anti")


@query("d2_split", "SELECT label, doc_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY (doc_id * 7919) % 1000003, doc_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM v_scored)")
def d2(spark, sf):
    return dataset.split(view(spark, sf, "v_scored"), order=[F.expr("(doc_id * 7919) % 1000003"), F.col("doc_id")]).select("label", "doc_id", "split")


@query("d6_weights", f"SELECT doc_id, label, {_q('1.0e0 / count(*) OVER (PARTITION BY label)', 9)} AS weight FROM v_scored")
def d6(spark, sf):
    return dataset.class_weights(view(spark, sf, "v_scored")).select("doc_id", "label", q(F.col("weight"), 9).alias("weight"))


@query("d1_label_actions", "SELECT folder, label, action, goal, count(*) AS n FROM (SELECT CASE k % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'hard_negative' ELSE 'qa' END AS folder, CASE k % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' WHEN 2 THEN 'partial' ELSE 'skip' END AS label FROM (SELECT c_custkey AS k FROM customer)) JOIN (VALUES ('positive','neg','move','negative'), ('positive','partial','move','partial'), ('hard_negative','pos','copy','positive'), ('hard_negative','partial','copy','partial'), ('qa','pos','copy','positive'), ('qa','neg','copy','hard_negative'), ('qa','partial','copy','partial')) r(f, l, action, goal) ON folder = f AND label = l GROUP BY 1, 2, 3, 4")
def d1(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("concat(c_name, '.png') AS file_name", "CASE c_custkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'hard_negative' ELSE 'qa' END AS folder", "CASE c_custkey % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' WHEN 2 THEN 'partial' ELSE 'skip' END AS label")
    return dataset.label_actions(rows, rows.select("folder", "file_name")).groupBy("folder", "label", "action", "goal").agg(F.count(F.lit(1)).alias("n"))


@query("k1_world_file")
def k1(spark, sf):
    return fit.fit_affine(view(spark, sf, "v_obs")).select("map_id", sinks.world_file_text().alias("value"))


# further functions, filters and data sets


@query("f2_strictly_inside", "SELECT map_id, count(*) AS n FROM v_obs WHERE px - 70 >= 0 AND py - 100 >= 0 AND px - 70 < 12000 AND py - 100 < 9000 GROUP BY 1")
def f2(spark, sf):
    inside = spatial.strictly_inside(F.col("px") - 70, F.col("py") - 100, F.lit(12000), F.lit(9000))
    return view(spark, sf, "v_obs").filter(inside).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


@query("f11_in_content", "SELECT map_id, count(*) AS n FROM v_obs WHERE px >= 100 AND px < 13900 AND py >= 100 AND py < least(9900, floor(10000 * 0.87e0)) GROUP BY 1")
def f11(spark, sf):
    return view(spark, sf, "v_obs").filter(spatial.in_content(F.col("px"), F.col("py"), F.lit(14000), F.lit(10000))).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


_CX, _CY = (189000.0, 0.85, -0.001, 1e-7, 2e-7, -1e-7), (630000.0, 0.002, -0.84, -2e-7, 1e-7, 3e-7)


@query("p7_polynomial", f"SELECT map_id, k1, k2, k3, k4, {', '.join(_q(' + '.join(f'{v!r}::DOUBLE * {t}' for v, t in zip(c, ('1', 'px', 'py', 'px * py', 'px * px', 'py * py')))) + f' AS {n}' for n, c in (('x', _CX), ('y', _CY)))} FROM v_obs")
def p7(spark, sf):
    x, y = affine.polynomial(F.col("px"), F.col("py"), F.array(*map(F.lit, _CX)), F.array(*map(F.lit, _CY)))
    return view(spark, sf, "v_obs").select(*KEY, q(x).alias("x"), q(y).alias("y"))


@query("p13_point_names", "SELECT k, CASE WHEN regexp_full_match(t, '[0-9]{1,4}[A-Z]') THEN concat(left(t, length(t) - 1), '/', right(t, 1)) ELSE t END AS name, CASE WHEN h > 0 AND h < 2000 AND c > 0.2 THEN h END AS height FROM (SELECT p_partkey AS k, concat(CAST(p_size * 37 AS VARCHAR), CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AB' ELSE '' END) AS t, TRY_CAST(concat(CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END, CAST(p_size * 50 AS VARCHAR)) AS DOUBLE) AS h, (p_partkey % 10) / 10 AS c FROM part)")
def p13(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS k", "concat(cast(p_size * 37 AS string), CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AB' ELSE '' END) AS t", "concat(CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END, cast(p_size * 50 AS string)) AS h", "(p_partkey % 10) / 10 AS c")
    return rows.select("k", names.point_name(F.col("t")).alias("name"), names.point_height(F.col("h"), F.col("c")).alias("height"))


@query("p22_size_change", f"SELECT map_id, {_q('abs(abs(a) - abs(a2)) / abs(a2)', 9)} AS on_x, {_q('abs(abs(d) - abs(d2)) / abs(d2)', 9)} AS on_y FROM (SELECT *, a * (1 + map_id * 1e-5) AS a2, d * (1 - map_id * 1e-5) AS d2 FROM (SELECT map_id, {_REF} FROM (SELECT s_suppkey AS map_id FROM supplier)))")
def p22(spark, sf):
    t = affine.columns()
    x, y = affine.size_change(t, t | {"a": t["a"] * F.expr("1 + map_id * 1e-5"), "d": t["d"] * F.expr("1 - map_id * 1e-5")})
    return _reference(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("map_id"))).select("map_id", q(x, 9).alias("on_x"), q(y, 9).alias("on_y"))


@query("j9_neighbour_pairs", "WITH c AS (SELECT map_id, gt, floor(qx / 500) AS cx, floor(qy / 500) AS cy FROM v_truth) SELECT a.map_id, count(*) AS n, sum(b.gt - a.gt)::BIGINT AS apart FROM c a JOIN c b ON a.map_id = b.map_id AND a.gt < b.gt AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY 1")
def j9(spark, sf):
    rows = view(spark, sf, "v_truth").selectExpr("map_id", "gt AS id", "qx AS px", "qy AS py")
    return spatial.neighbour_pairs(rows, 500.0).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("other") - F.col("id")).alias("apart"))


_FOLDERS = "SELECT concat('f', CAST(c_custkey AS VARCHAR(20)), '.png') AS file_name, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'partial' ELSE 'negative' END AS folder FROM customer"


def _folders(spark, sf) -> DataFrame:
    return spark.sql(_FOLDERS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf, "customer"))


@query("a17_label_counts", f"SELECT folder, count(CASE WHEN l = 'pos' THEN 1 END) AS pos, count(CASE WHEN l = 'neg' THEN 1 END) AS neg, count(CASE WHEN l = 'partial' THEN 1 END) AS partial, count(CASE WHEN l = 'skip' THEN 1 END) AS skip, count(CASE WHEN l IS NULL THEN 1 END) AS remaining FROM (SELECT folder, CASE k % 6 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' WHEN 2 THEN 'partial' WHEN 3 THEN 'skip' END AS l FROM ({_FOLDERS})) GROUP BY 1")
def a17(spark, sf):
    files = _folders(spark, sf)
    marks = files.withColumn("label", F.expr("CASE k % 6 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' WHEN 2 THEN 'partial' WHEN 3 THEN 'skip' END")).filter("label IS NOT NULL")
    return dataset.label_counts(marks.drop("k"), files.drop("k"))


@query("k11_reject_actions", f"SELECT folder, 'negative' AS goal, count(*) AS n FROM (SELECT file_name, max(folder) AS folder FROM ({_FOLDERS}) WHERE folder IN ('positive', 'partial') AND k % 5 = 0 GROUP BY 1) GROUP BY 1")
def k11(spark, sf):
    files = _folders(spark, sf)
    return dataset.reject_actions(files.filter("k % 5 = 0"), files).groupBy("folder", "goal").agg(F.count(F.lit(1)).alias("n"))


@query("d3_split_val_first", "SELECT label, doc_id, CASE WHEN k <= floor(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY (doc_id * 7919) % 1000003, doc_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM v_scored)")
def d3(spark, sf):
    return dataset.split_val_first(view(spark, sf, "v_scored"), order=[F.expr("(doc_id * 7919) % 1000003"), F.col("doc_id")]).select("label", "doc_id", "split")


@query("f14_without_held_out", "SELECT k4 AS map_id, count(*) AS n FROM v_name WHERE split_part(file_name, '_', 1) NOT IN ('M3', 'M7') GROUP BY 1")
def f14(spark, sf):
    held = spark.createDataFrame([("M3",), ("M7",)], "map_id string")
    return dataset.without_held_out(view(spark, sf, "v_name"), held).groupBy(F.col("k4").alias("map_id")).agg(F.count(F.lit(1)).alias("n"))


@query("w7_first_of", "SELECT map_id, k1, k2, k3, k4 FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY px, py, k1, k2, k3, k4) AS r FROM v_obs) WHERE r = 1")
def w7(spark, sf):
    return dataset.first_of(view(spark, sf, "v_obs"), ["map_id"], [F.col(c) for c in ("px", "py", "k1", "k2", "k3", "k4")]).select(*KEY)


def slice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident, well-distributed points of each map, their transform without outliers, and how good it is."""
    picks = settled(_picked(spark, sf_dir, n=50).drop("pick"))  # at most 50 rows a map, used five times
    return rounded(fit.trim_and_refit(picks), 6)


QUERIES["flagship"] = slice_query
ORACLES["flagship"] = with_views(
    f"""WITH v AS (SELECT map_id, k.px AS px, k.py AS py, k.x AS x, k.y AS y FROM ({_SPREAD.format(n=50, d="200")})), t AS ({_fit_sql('v')}), r AS (SELECT o.*, {_ERR} AS err FROM v o JOIN t ON o.map_id = t.map_id),
    s AS (SELECT map_id, greatest(15, 2 * sqrt(avg(err * err))) AS lim, count(*) AS n FROM r GROUP BY 1), k AS (SELECT r.* FROM r JOIN s ON r.map_id = s.map_id WHERE err < lim),
    i AS (SELECT s.map_id, s.n, count(k.map_id) AS n_in FROM s LEFT JOIN k ON s.map_id = k.map_id GROUP BY 1, 2),
    z AS (SELECT map_id, px, py, x, y FROM v WHERE map_id IN (SELECT map_id FROM i WHERE NOT (n_in >= 3 AND n_in < n)) UNION ALL SELECT map_id, px, py, x, y FROM k WHERE map_id IN (SELECT map_id FROM i WHERE n_in >= 3 AND n_in < n)),
    u AS ({_fit_sql('z')}), w AS (SELECT map_id, {_RMSE.replace(' * 1000 ', ' * 1000000 ').replace('1000.0', '1000000.0')} FROM (SELECT o.map_id, {_ERR.replace('t.', 'u.')} AS err FROM z o JOIN u ON o.map_id = u.map_id) GROUP BY 1)
    SELECT u.map_id, {', '.join(f'{_q(n, 6)} AS {n}' for n in affine.NAMES)}, i.n, CASE WHEN i.n_in < 3 THEN i.n ELSE i.n_in END AS n_inliers, rmse_component_m, rmse_radial_m, max_error_m FROM u JOIN w ON u.map_id = w.map_id JOIN i ON u.map_id = i.map_id"""
)


_SCORED = "SELECT o_custkey AS map_id, CASE o_orderkey % 2 WHEN 0 THEN 'old' ELSE 'new' END AS frame, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey * 37 % 128) / 128e0 END AS score FROM orders"
_SCORES = f"SELECT map_id, frame, coalesce(avg(score), -1e0) AS mean_score, count(score) AS n_valid FROM ({_SCORED}) GROUP BY 1, 2"


def _template_scores(spark, sf) -> DataFrame:
    return evaluate.template_score(spark.sql(_SCORED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders")), ["map_id", "frame"])


@query("a19_template_score", _SCORES)
def a19(spark, sf):
    return _template_scores(spark, sf)


@query("f7_trusted", f"SELECT * FROM ({_SCORES}) WHERE n_valid >= 3 AND mean_score >= 0.3e0")
def f7(spark, sf):
    return evaluate.trusted(_template_scores(spark, sf))


@query("f8_better_frame", f"WITH s AS (SELECT map_id, frame, CASE WHEN n_valid >= 3 AND mean_score >= 0.3e0 THEN mean_score ELSE -1e0 END AS s FROM ({_SCORES})), r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY s DESC, frame DESC) AS r FROM s) SELECT a.map_id, a.frame, a.s AS mean_score FROM r a LEFT JOIN r b ON a.map_id = b.map_id AND b.r = 2 WHERE a.r = 1 AND a.s >= 0.3e0 AND a.s - coalesce(b.s, -1e0) >= 0.05e0")
def f8(spark, sf):
    return evaluate.better_frame(_template_scores(spark, sf))
