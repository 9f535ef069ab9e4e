"""Tables and small text formats: control points, world files, points files, GCP metadata, JSON marks and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def read_control_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, skipped) of a control-point CSV with the header Name, New_E, New_N, Old_E, Old_N, Height (a byte order mark may lead).

    The file's New_N is the easting, New_E the northing.  Blank old coordinates
    are 0; rows without a number where one must be are in ``skipped``.  Heights stay text."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    got = {k: F.col(f"`{names[k]}`") if k in names else F.lit(None).cast("string") for k in ("name", "new_e", "new_n", "old_e", "old_n", "height")}

    def old(c: Column) -> Column:
        return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(0.0)).otherwise(_number(c))

    rows = raw.select(
        F.trim(got["name"]).alias("name"),
        _number(got["new_n"]).alias("easting_6991"),
        _number(got["new_e"]).alias("northing_6991"),
        old(got["old_e"]).alias("old_e"),
        old(got["old_n"]).alias("old_n"),
        F.trim(F.coalesce(got["height"], F.lit(""))).alias("height"),
    )
    bad = F.greatest(*[F.col(c).isNull() for c in ("easting_6991", "northing_6991", "old_e", "old_n")])
    return rows.filter(~bad), rows.filter(bad)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, map_id, a..f, reject_reason): the first six lines with content, as a, b, c, d, e, f.

    c multiplies the row in x.  Files with fewer numbers, or a transform without
    inverse, have a reason."""
    rows = _whole(spark, path).withColumn("_v", F.transform(F.slice(_lines(F.col("value")), 1, 6), lambda x: x.try_cast("double")))
    t = {n: F.get("_v", F.lit(i)) for i, n in enumerate("abcdef")}
    short = (F.size("_v") < 6) | F.exists("_v", lambda x: x.isNull())
    reason = F.when(short, "fewer than six numbers").when(t["a"] * t["d"] - t["b"] * t["c"] == 0, "singular")
    folder = F.nullif(F.regexp_extract("path", r"/map_id=([^/]+)/", 1), F.lit(""))  # as this package's writer lays them out
    return rows.select("path", F.coalesce(folder, _map_id(F.col("path"))).alias("map_id"), *[t[n].alias(n) for n in "abcdef"], reason.alias("reject_reason"))


def _map_id(path: Column) -> Column:
    """The stem of a path up to its first point, without the endings of control-point exports."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^/]*)?$", 1), r"(?i)_control_?points$", "")


def read_control_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, map_id, map_x, map_y, enable) of strict exports: header, five fields, comma; blank enable is 1.  A field that must be a number and isn't raises."""
    rows = _whole(spark, path).select("path", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("_i", "_l")).filter("_i > 0 AND trim(_l) <> ''")
    f = F.split(F.trim("_l"), ",")
    enable = F.when(F.trim(f[4]) == "", F.lit(1)).otherwise(F.trim(f[4]).cast("int"))
    return rows.filter(F.size(f) >= 5).select("path", _map_id(F.col("path")).alias("map_id"), F.trim(f[0]).cast("double").alias("map_x"), F.trim(f[1]).cast("double").alias("map_y"), enable.alias("enable"))


def read_points_files(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """(path, map_id, map_x, map_y) of tolerant points files; lines that aren't numbers are passed over, the enable flag doesn't count.

    layout ``new``: the third and fourth number of a line; ``old``: the first
    two; ``auto``: new where the third and fourth are larger than 10,000, else
    old where the first is, which misreads old lines whose pixels are that large."""
    rows = _whole(spark, path).select("path", F.explode(F.split("value", r"\r\n|\r|\n")).alias("_l"))
    v = F.transform(F.filter(F.split(F.trim(F.regexp_replace("_l", ",", " ")), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = rows.withColumn("_v", v).filter(~F.exists("_v", lambda x: x.isNull()))

    def at(i: int) -> Column:
        return F.get("_v", F.lit(i))

    n = F.size("_v")
    is_new = (n >= 4) & (F.abs(at(2)) > 10_000) & (F.abs(at(3)) > 10_000)
    is_old = (n >= 2) & (F.abs(at(0)) > 10_000)
    if layout == "new":
        is_new, is_old = n >= 4, F.lit(False)
    elif layout == "old":
        is_new, is_old = F.lit(False), n >= 2
    x, y = F.when(is_new, at(2)).when(is_old, at(0)), F.when(is_new, at(3)).when(is_old, at(1))
    return rows.select("path", _map_id(F.col("path")).alias("map_id"), x.alias("map_x"), y.alias("map_y")).filter("map_x IS NOT NULL")


def read_aux_gcps(spark: SparkSession, path: str) -> DataFrame:
    """(path, map_id, i, source_x, source_y, target_x, target_y) of GCP metadata in XML.

    Elements count whose name ends in SourceGCPs or TargetGCPs, in any name space; their numbers alternate x, y.  Files that
    can't be parsed, with an odd count, unequal sides, or fewer than three pairs have no row."""
    rows = _whole(spark, path).withColumn("value", well_formed("value")).filter("value IS NOT NULL")

    def side(name: str) -> Column:
        query = f"//*[substring(local-name(), string-length(local-name()) - {len(name) - 1}) = '{name}']/*/text()"
        return F.transform(F.xpath(F.col("value"), F.lit(query)), lambda x: F.trim(x).try_cast("double"))

    rows = rows.withColumns({"_s": side("SourceGCPs"), "_t": side("TargetGCPs")})
    ok = (F.size("_s") == F.size("_t")) & (F.size("_s") % 2 == 0) & (F.size("_s") >= 6) & ~F.exists("_s", lambda x: x.isNull()) & ~F.exists("_t", lambda x: x.isNull())
    rows = rows.filter(ok).withColumn("i", F.explode(F.sequence(F.lit(1), (F.size("_s") / 2).cast("int"))))

    def at(side: str, k: Column) -> Column:
        return F.get(side, k.cast("int"))

    i = F.col("i")
    return rows.select("path", _map_id(F.col("path")).alias("map_id"), "i", at("_s", i * 2 - 2).alias("source_x"), at("_s", i * 2 - 1).alias("source_y"), at("_t", i * 2 - 2).alias("target_x"), at("_t", i * 2 - 1).alias("target_y"))


@F.pandas_udf(StringType())
def well_formed(text: pd.Series) -> pd.Series:
    """The text if an XML parser takes it, else null: XPath functions raise on anything else."""
    from xml.etree import ElementTree

    def checked(t):
        try:
            ElementTree.fromstring(t.encode())
        except (ElementTree.ParseError, AttributeError):
            return None
        return t

    return text.map(checked)


MARK = "array<struct<x: double, y: double, cnn: double, source: string>>"
MARKS = f"map string, file string, cnn_threshold double, detections {MARK}, manual_marks {MARK}, false_positives {MARK}"


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """(path, map_id, file, cnn_threshold, kind, x, y, cnn, source) of quality marks in JSON; kind is detection, manual or false_positive."""
    rows = _whole(spark, path).withColumn("_j", F.from_json("value", MARKS)).filter("_j IS NOT NULL")
    parts = [rows.select("path", F.col("_j.map").alias("map_id"), F.col("_j.file").alias("file"), F.col("_j.cnn_threshold").alias("cnn_threshold"), F.lit(n).alias("kind"), F.inline(f"_j.{k}")) for k, n in (("detections", "detection"), ("manual_marks", "manual"), ("false_positives", "false_positive"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_labels(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_name, label) of a curation file: JSON of names and labels.  The first of ``paths`` that exists counts; none: no row."""
    for path in paths:
        if exists(spark, path):
            rows = _whole(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("file_name", "label"))
            return rows
    return spark.createDataFrame([], "file_name string, label string")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file_name) of a list of names in JSON."""
    return _whole(spark, path).select(F.explode(F.from_json("value", "array<string>")).alias("file_name"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system it belongs to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
