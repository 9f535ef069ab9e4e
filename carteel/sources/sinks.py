"""Writers of transforms, detections, summaries, marks and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTION = ("name", "confidence", "method", "pixel_x", "pixel_y", "easting_6991", "northing_6991", "old_e", "old_n", "height")


def world_file_text() -> Column:
    """The six lines of a world file, without the last line's end."""
    return F.concat_ws("\n", *[F.format_string("%.10f", F.col(c)) for c in "abcd"], *[F.format_string("%.6f", F.col(c)) for c in "ef"])


def write_world_files(transforms: DataFrame, path: str) -> None:
    """One folder ``map_id=...`` for each map with the text of its world file."""
    transforms.select("map_id", world_file_text().alias("value")).write.mode("overwrite").partitionBy("map_id").text(path)


def detection_rows(detections: DataFrame) -> DataFrame:
    """Detections as text with fixed decimals."""
    digits = {"confidence": 4, "pixel_x": 1, "pixel_y": 1, "easting_6991": 3, "northing_6991": 3, "old_e": 2, "old_n": 2}
    return detections.select(*[F.format_string(f"%.{digits[c]}f", F.col(c)).alias(c) if c in digits else F.col(c).cast("string").alias(c) for c in DETECTION])


def write_detections(detections: DataFrame, path: str) -> None:
    detection_rows(detections).write.mode("overwrite").option("header", True).csv(path)


SUMMARY = ("map_name", "n_points", "n_inliers", "affine_rmse_m", "ransac_rmse_m", "max_error_m", "fit_rmse_m")


def summary_rows(results: DataFrame) -> DataFrame:
    """Results of a run as text, two decimals, blank where missing."""
    return results.select(*[F.coalesce(F.format_string("%.2f", F.col(c)) if c.endswith("_m") else F.col(c).cast("string"), F.lit("")).alias(c) for c in SUMMARY])


def write_summary(results: DataFrame, path: str) -> None:
    summary_rows(results).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def marks_json(marks: DataFrame) -> DataFrame:
    """(map_id, value): the JSON of a map's quality marks.  marks: map_id, file, cnn_threshold, kind, x, y, cnn, source."""

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("x", "y", "cnn", "source"))))

    got = marks.groupBy("map_id", "file", "cnn_threshold").agg(of("detection").alias("detections"), of("manual").alias("manual_marks"), of("false_positive").alias("false_positives"))
    return got.select("map_id", F.to_json(F.struct(F.col("map_id").alias("map"), "file", "cnn_threshold", "detections", "manual_marks", "false_positives"), {"ignoreNullFields": "false"}).alias("value"))


def write_marks(marks: DataFrame, path: str) -> None:
    marks_json(marks).write.mode("overwrite").partitionBy("map_id").text(path)


def crop_route(probability: Column, threshold: float, floor: float = 0.40) -> Column:
    """Where a scored crop goes: candidates, hard negatives, or nowhere (null)."""
    return F.when(probability >= threshold, "qa_candidates").when(probability >= floor, "hard_negatives")


def crop_name(map_id: Column, x: Column, y: Column, confidence: Column | None = None, tag: str | None = None) -> Column:
    """``<map>_x<col>_y<row>[_c<conf>][_tag].png``; positions are rounded half to even."""
    parts = [map_id, F.concat(F.lit("x"), F.rint(x).cast("long").cast("string")), F.concat(F.lit("y"), F.rint(y).cast("long").cast("string"))]
    if confidence is not None:
        parts.append(F.concat(F.lit("c"), F.format_string("%.2f", confidence)))
    if tag:
        parts.append(F.lit(tag))
    return F.concat(F.concat_ws("_", *parts), F.lit(".png"))


def write_crops(crops: DataFrame, path: str) -> None:
    """(file_name, bucket, data) as Parquet, a folder for each bucket.  Names make the write idempotent: filter by ``operators.spatial.thin_new`` before."""
    crops.write.mode("append").partitionBy("bucket").parquet(path)


def annotation_lines(boxes: DataFrame) -> DataFrame:
    """``class cx cy w h`` with six decimals, relative to the image.  boxes: class, cx, cy, w, h, width, height in pixels."""
    rel = [F.format_string("%.6f", F.col(c) / F.col(s)) for c, s in (("cx", "width"), ("cy", "height"), ("w", "width"), ("h", "height"))]
    return boxes.select(*[c for c in boxes.columns if c in ("map_id", "file_name")], F.concat_ws(" ", F.col("class").cast("string"), *rel).alias("value"))


def log_text(log: DataFrame) -> DataFrame:
    """Entries (timestamp, elapsed_s, level, message, extra) as lines of text."""
    extra = F.array_join(F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    return log.select(F.rtrim(F.format_string("[%8.2fs] %-6s %s %s", "elapsed_s", "level", "message", F.coalesce(extra, F.lit("")))).alias("value"))


def log_json(log: DataFrame) -> DataFrame:
    return log.select(F.to_json(F.struct("timestamp", "elapsed_s", "level", "message", "extra")).alias("value"))


def write_split(crops: DataFrame, path: str) -> None:
    """(file_name, split, label, ...) as Parquet in folders ``split=``/``label=``."""
    crops.write.mode("overwrite").partitionBy("split", "label").parquet(path)
