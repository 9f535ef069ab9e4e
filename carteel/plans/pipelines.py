"""Whole runs over many maps at once: what a loop over maps would do one by one.

Every step takes and returns tables keyed by ``map_id``; a map that fails a gate
leaves the tables with its reason in the report instead of stopping the run.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import affine, buckets
from ..functions import labels as label_functions
from ..functions import names
from ..operators import evaluate, fit, labels, spatial


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder of ``spark.checkpoint.dir``: later steps neither compute nor plan it again,
    and no lost executor takes it along.  Where that is unset, a local session gets a temporary folder, a cluster an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="carteel-"))
    return df.checkpoint()


@dataclass(frozen=True)
class Bootstrap:
    """The results of a bootstrap run."""

    label_transforms: DataFrame
    labels_used: DataFrame
    candidates: DataFrame
    transforms: DataFrame
    report: DataFrame


def clean_readings(readings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Labels (map_id, axis, id, pos, val, conf, edge) from raw readings: prefix and digit repair against each map's ranges, one
    reading a place, digit repair by the series, validation, and opposite edges merged.

    readings: map_id, edge, id, pos, val, conf; ranges: map_id, easting_lo, easting_hi, northing_lo, northing_hi, null where unknown (0 to 300 then)."""
    east = F.col("edge").isin("top", "bottom")
    lo = F.coalesce(F.when(east, F.col("easting_lo")).otherwise(F.col("northing_lo")), F.lit(0))
    hi = F.coalesce(F.when(east, F.col("easting_hi")).otherwise(F.col("northing_hi")), F.lit(300))
    got = label_functions.accepted(F.col("val"), F.col("conf"), lo, hi)
    rows = readings.filter("conf >= 0.2").join(ranges, "map_id", "left").withColumn("_a", got).filter("_a IS NOT NULL")
    rows = rows.select("map_id", "edge", "id", "pos", F.col("_a.value").alias("val"), F.col("_a.confidence").alias("conf"))
    rows = settled(labels.dedupe_readings(rows))
    # series of one edge: the edge stands in for the axis until the two are merged
    rows = rows.select("map_id", F.col("edge").alias("axis"), "id", "pos", "val", "conf")
    rows = labels.validate_sequence(settled(labels.repair_digits(rows)))
    rows = rows.select("map_id", F.when(F.col("axis").isin("top", "bottom"), "easting").otherwise("northing").alias("axis"), "id", "pos", "val", "conf", F.col("axis").alias("edge"))
    merged = labels.merge_edges(rows)
    return merged.select("map_id", "axis", F.col("val").cast("long").alias("id"), "pos", "val", "conf", "edge")


def bootstrap(readings: DataFrame, neatlines: DataFrame, files: DataFrame, points: DataFrame, verify, n: int = 50, least: float = 0.75, distance: float = 200.0, margin: float = 1000.0, bin_size: float = 10_000.0) -> Bootstrap:
    """Transforms of maps without any georeference, from their labels and the control points they show.

    readings: see ``clean_readings``; neatlines: map_id, top, bottom, left, right;
    files: map_id, file_name; points: pid, easting, northing, old_e, old_n;
    verify(candidates) -> the candidates (map_id, pid, px, py) with confidence: a matcher over the images, such as ``imaging.verify_candidates``."""
    ranges = files.select("map_id", names.label_ranges(F.col("file_name")).alias("r")).select("map_id", "r.*")
    clean = settled(clean_readings(readings, ranges))
    transforms, used = labels.label_affine(clean.drop("edge"))
    transforms, used = settled(transforms), settled(used)
    sound = transforms.filter("reject_reason IS NULL")
    used = used.join(sound.select("map_id"), "map_id", "left_semi").join(clean.select("map_id", "axis", "id", "edge"), ["map_id", "axis", "id"])
    used = settled(used)
    grid = labels.grid_points(used, sound, neatlines)
    old = fit.fit_affine(grid.select("map_id", F.col("pixel_x").alias("px"), F.col("pixel_y").alias("py"), F.col("old_n").alias("x"), F.col("old_e").alias("y")))
    extent = labels.label_extent(used).select("map_id", F.col("old_n_min").alias("min_x"), F.col("old_n_max").alias("max_x"), F.col("old_e_min").alias("min_y"), F.col("old_e_max").alias("max_y"))
    near = spatial.box_join(points, extent, "old_n", "old_e", margin, bin_size=bin_size)
    px, py = affine.map_to_pixel(F.col("old_n"), F.col("old_e"))
    candidates = near.join(old.select("map_id", *affine.NAMES), "map_id").select("map_id", "pid", px.alias("px"), py.alias("py"))
    candidates = settled(candidates)
    found = verify(candidates).join(points.select("pid", F.col("easting").alias("x"), F.col("northing").alias("y")), "pid")
    final = settled(select_and_fit(settled(found), n, least, distance))
    report = sound.select("map_id").unionByName(transforms.filter("reject_reason IS NOT NULL").select("map_id")).join(transforms.select("map_id", "reject_reason"), "map_id").join(final.select("map_id", "n", "n_inliers", "rmse_radial_m", "max_error_m"), "map_id", "left")
    report = report.withColumn("status", F.coalesce("reject_reason", F.when(F.col("n").isNull(), "too few points"), F.lit("ok"))).drop("reject_reason")
    return Bootstrap(transforms, used, candidates, final, report)


def select_and_fit(found: DataFrame, n: int = 50, least: float = 0.5, distance: float = 200.0) -> DataFrame:
    """Confident, well-distributed detections (map_id, pid, px, py, x, y, confidence) of each map, fitted, trimmed, and fitted again."""
    rows = found.filter(F.col("confidence") >= least).withColumn("_down", -F.col("confidence"))
    return fit.trim_and_refit(settled(spatial.select_spread(rows, ["_down", "pid"], ["pid", "px", "py", "x", "y"], n, distance)))


def refit_check(found: DataFrame, truth: DataFrame, n: int = 50, least: float = 0.5, distance: float = 200.0) -> DataFrame:
    """Maps with a georeference: the plain and the robust fit of their detections, each graded at the control points.

    The detections were found with the georeference itself, so this is no blind accuracy."""
    rows = found.filter(F.col("confidence") >= least).withColumn("_down", -F.col("confidence"))
    picks = settled(spatial.select_spread(rows, ["_down", "pid"], ["pid", "px", "py", "x", "y"], n, distance).withColumnRenamed("pick", "id"))
    plain = fit.fit_affine(picks)
    robust = fit.fit_affine(fit.sampled_consensus(picks.select("map_id", "id", "px", "py", "x", "y")))

    def graded(fits: DataFrame, kind: str) -> DataFrame:
        return evaluate.transform_error(truth, fits).select("map_id", F.col("median_m").alias(f"{kind}_median_m"), F.col("max_m").alias(f"{kind}_max_m"))

    out = plain.select("map_id", F.col("n").alias("n_points"), F.col("rmse_component_m").alias("affine_rmse_m"), F.col("max_error_m"))
    out = out.join(robust.select("map_id", F.col("n").alias("n_inliers"), F.col("rmse_component_m").alias("ransac_rmse_m")), "map_id", "left")
    return out.join(graded(plain, "affine"), "map_id", "left").join(graded(robust, "ransac"), "map_id", "left").withColumn("class", buckets.error_status(F.col("affine_median_m")))


def best_transform(candidates: DataFrame) -> DataFrame:
    """The most trusted transform of each map.  candidates: map_id, rank (1: world file, 2: recovered from GCPs, ...), a..f, and mean_score and n_valid where verified."""
    ok = candidates.filter("rank = 1 OR (n_valid >= 3 AND mean_score >= 0.30)")
    return ok.groupBy("map_id").agg(F.min_by(F.struct(*affine.NAMES), "rank").alias("_t"), F.min("rank").alias("rank")).select("map_id", "rank", "_t.*")


def harvest(found: DataFrame, existing: DataFrame, transforms: DataFrame, held_out: list[str], least: float = 0.60) -> DataFrame:
    """New crop positions of maps that aren't held out and whose symbols are large enough (0.2 m a pixel): the best first, none within 10 px of another or of an existing one.

    found: map_id, pid, px, py, confidence; existing: map_id, qx, qy."""
    fine = transforms.filter(F.abs("a") >= 0.2).select("map_id")
    rows = found.filter((F.col("confidence") >= least) & ~F.col("map_id").isin(*held_out)).join(fine, "map_id", "left_semi")
    ranked = spatial.top_of_each(rows, [F.desc("confidence"), "pid"], None).withColumnRenamed("rank", "id")
    return spatial.thin_new(ranked, existing).join(ranked.select("map_id", "id", "pid", "confidence"), ["map_id", "id"])
