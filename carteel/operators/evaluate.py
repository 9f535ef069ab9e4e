"""Grading of transforms and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine, buckets



def transform_error(truth: DataFrame, transforms: DataFrame, key: str = "map_id") -> DataFrame:
    """Error of each map's transform at its enabled control points: n, mean, max, RMSE (radial) and median in metres; NaN for maps without any.

    truth: map_id, px, py, x, y, enable."""
    x, y = affine.pixel_to_map(F.col("px"), F.col("py"))
    graded = transforms.join(truth.filter("enable = 1").select(key, "px", "py", "x", "y"), key, "left").withColumn("_e", F.hypot(F.col("x") - x, F.col("y") - y))
    nan = F.lit(float("nan"))
    return graded.groupBy(key).agg(
        F.count("_e").alias("n"),
        F.coalesce(F.avg("_e"), nan).alias("mean_m"),
        F.coalesce(F.max("_e"), nan).alias("max_m"),
        F.coalesce(F.sqrt(F.avg(F.col("_e") * F.col("_e"))), nan).alias("rmse_radial_m"),
        F.coalesce(F.median("_e"), nan).alias("median_m"),
    )


def _rates(tp: Column, found: Column, there: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(tp, found), F.lit(0.0)), F.coalesce(F.try_divide(tp, there), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall")]


def detection_report(detections: DataFrame, truth: DataFrame, matches: DataFrame, total: bool = True) -> DataFrame:
    """Detections, truths, matches, precision, recall and mean distance of each map, and of all together in a row with a null map_id.

    ``matches``: of operators.spatial.match_nearest."""
    parts = [
        detections.select("map_id", F.lit(1).alias("d"), F.lit(0).alias("t"), F.lit(0).alias("m"), F.lit(None).cast("double").alias("distance")),
        truth.select("map_id", F.lit(0), F.lit(1), F.lit(0), F.lit(None).cast("double")),
        matches.select("map_id", F.lit(0), F.lit(0), F.lit(1), "distance"),
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    counts = [F.sum("d").alias("detections"), F.sum("t").alias("truths"), F.sum("m").alias("matches"), F.avg("distance").alias("mean_px")]
    got = rows.groupingSets([[F.col("map_id")], []], F.col("map_id")).agg(*counts, F.grouping("map_id").alias("_total")) if total else rows.groupBy("map_id").agg(*counts, F.lit(0).alias("_total"))
    return got.select("map_id", F.col("_total").cast("boolean").alias("is_total"), "detections", "truths", "matches", *_rates(F.col("matches"), F.col("detections"), F.col("truths")), "mean_px")


def confusion(scored: DataFrame, threshold: float = 0.5, by: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy of ``prob >= threshold`` against ``label``, for each ``by`` and, with a null ``by``, for all."""
    hit, real = F.col("prob") >= threshold, F.col("label") == 1
    counts = [F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn")]
    if by is None:
        got = scored.agg(*counts)
    else:
        got = scored.groupingSets([[F.col(by)], []], F.col(by)).agg(*counts, F.grouping(by).alias("_total")).withColumn("is_total", F.col("_total").cast("boolean")).drop("_total")
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    accuracy = (F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(1))
    return got.withColumns({"precision": p, "recall": r}).withColumns({"f1": f1, "accuracy": accuracy})


def threshold_for_recall(scored: DataFrame, least: float = 0.85, key: str = "fold") -> DataFrame:
    """(fold, threshold, precision, recall): for each fold the highest score at which recall reaches ``least``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc("prob"))
    ties = w.rangeBetween(Window.unboundedPreceding, 0)
    rows = scored.withColumns({"_tp": F.sum("label").over(ties), "_n": F.count(F.lit(1)).over(ties), "_all": F.sum("label").over(Window.partitionBy(key))})
    rows = rows.select(key, "prob", (F.col("_tp") / F.col("_n")).alias("precision"), (F.col("_tp") / F.greatest(F.col("_all"), F.lit(1))).alias("recall")).filter(F.col("recall") >= least)
    return rows.groupBy(key).agg(F.max_by(F.struct("prob", "precision", "recall"), "prob").alias("_b")).select(key, F.col("_b.prob").alias("threshold"), "_b.precision", "_b.recall")


def template_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean best template score over valid positions (-1 without any), and their number.  scored: keys, score (null where the crop leaves the image)."""
    return scored.groupBy(*keys).agg(F.coalesce(F.avg("score"), F.lit(-1.0)).alias("mean_score"), F.count("score").alias("n_valid"))


def trusted(scores: DataFrame, least: int = 3, mean: float = 0.30) -> DataFrame:
    """Transforms whose symbols are where they should be."""
    return scores.filter((F.col("n_valid") >= least) & (F.col("mean_score") >= mean))


def better_frame(scores: DataFrame, key: str = "map_id", margin: float = 0.05) -> DataFrame:
    """(map_id, frame, mean_score): the frame of ``template_score(…, [map_id, frame])`` that is trusted and beats the other by ``margin``."""
    w = F.sort_array(F.collect_list(F.struct(F.when((F.col("n_valid") >= 3) & (F.col("mean_score") >= 0.30), F.col("mean_score")).otherwise(-1.0).alias("s"), "frame")), asc=False)
    got = scores.groupBy(key).agg(w.alias("_s"))
    first, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    ok = (first["s"] >= 0.30) & (first["s"] - F.coalesce(second["s"], F.lit(-1.0)) >= margin)
    return got.filter(ok).select(key, first["frame"].alias("frame"), first["s"].alias("mean_score"))


def blind_grade(truth: DataFrame, fitted: DataFrame, reference: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean, median and largest error of a blind fit at control points inside the image (pixels by the reference transform), and
    the largest drift of a corner.  Maps without a fit have the status ``no fit``."""
    ref = reference.select("map_id", *[F.col(n).alias(f"r_{n}") for n in affine.NAMES]).join(sizes.select("map_id", "width", "height"), "map_id")
    theirs, ours = affine.columns("r_"), affine.columns()
    px, py = affine.map_to_pixel(F.col("x"), F.col("y"), theirs)
    points = truth.select("map_id", "x", "y").join(ref, "map_id").withColumns({"px": px, "py": py}).filter((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") < F.col("height")))
    x, y = affine.pixel_to_map(F.col("px"), F.col("py"), ours)
    errors = points.join(fitted.select("map_id", *affine.NAMES), "map_id").withColumn("_e", F.hypot(F.col("x") - x, F.col("y") - y)).groupBy("map_id").agg(F.count("_e").alias("n"), F.avg("_e").alias("mean_m"), F.median("_e").alias("median_m"), F.max("_e").alias("max_m"))
    drift = ref.join(fitted.select("map_id", *affine.NAMES), "map_id", "left").select("map_id", affine.corner_drift(ours, theirs, F.col("width").cast("double"), F.col("height").cast("double")).alias("corner_max_m"), F.when(F.col("a").isNull(), "no fit").otherwise("ok").alias("status"))
    return drift.join(errors, "map_id", "left").withColumn("class", F.when(F.col("status") == "ok", buckets.error_status(F.col("median_m"))))


def summary(graded: DataFrame) -> DataFrame:
    """One row over the maps that are ok: their number, and the medians of their errors."""
    ok = graded.filter("status = 'ok'")
    return ok.agg(F.count(F.lit(1)).alias("maps"), F.median("median_m").alias("median_of_medians_m"), F.median("mean_m").alias("median_of_means_m"), F.max("max_m").alias("worst_m"), F.median("corner_max_m").alias("median_corner_m"))


def projection_disagreement(points: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """(map_id, pid, dx_px, dy_px): where two transforms put the same control point.  ``one`` maps old-grid coordinates, ``other`` world coordinates.

    points: map_id, pid, old_e, old_n, easting, northing."""
    left = points.join(one.select("map_id", *affine.NAMES), "map_id")
    ax, ay = affine.map_to_pixel(F.col("old_n"), F.col("old_e"))
    left = left.select("map_id", "pid", "easting", "northing", ax.alias("_ax"), ay.alias("_ay")).join(other.select("map_id", *affine.NAMES), "map_id")
    bx, by = affine.map_to_pixel(F.col("easting"), F.col("northing"))
    return left.select("map_id", "pid", (F.col("_ax") - bx).alias("dx_px"), (F.col("_ay") - by).alias("dy_px"))


def run_summary(fits: DataFrame) -> DataFrame:
    """Medians and means over maps of the columns of a run's results."""
    return fits.agg(F.count(F.lit(1)).alias("maps"), F.median("rmse_radial_m").alias("median_rmse_m"), F.avg("rmse_radial_m").alias("mean_rmse_m"), F.median("max_error_m").alias("median_max_m"), F.avg("n").alias("mean_points"))


