"""Listings of map folders and image files, read without their content where that isn't asked for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = ("jpg", "jpeg", "tif", "tiff", "png")
#: Assets by file extension, better ones first.
KINDS = {
    "image": ("jpg", "jpeg", "tif", "tiff", "png"),
    "tfwx": ("tfwx", "tfw", "jgw", "jgwx", "wld"),
    "points": ("txt", "points", "csv"),
    "aux": ("xml",),
}


def listing(spark: SparkSession, *folders: str, pattern: str | None = None) -> DataFrame:
    """(path, folder, file_name, stem, extension, size) of all files below the folders.  Only names are read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        read = read.option("pathGlobFilter", pattern)
    rows = read.load(list(folders)).select("path", F.col("length").alias("size"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return rows.select("path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), name.alias("file_name"), F.regexp_extract(name, r"^([^.]*)", 1).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), "size")


def _rank(extension: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, kinds)), extension)


def assets(files: DataFrame, prefix: str = "M") -> DataFrame:
    """(map_id, image, tfwx, points, aux): the best file of each kind for each map, null without one.

    The map is the stem up to the first point, without the endings of
    control-point exports; other stems than those with ``prefix`` aren't maps."""
    rows = files.withColumn("map_id", F.regexp_replace("stem", r"(?i)_control_?points$", "")).filter(F.col("map_id").startswith(prefix))
    kind, rank = None, None
    for name, ends in KINDS.items():
        hit = F.col("extension").isin(*ends)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        rank = F.when(hit, _rank(F.col("extension"), ends)) if rank is None else rank.when(hit, _rank(F.col("extension"), ends))
    rows = rows.withColumns({"_kind": kind, "_rank": rank}).filter("_kind IS NOT NULL")
    return rows.groupBy("map_id").pivot("_kind", list(KINDS)).agg(F.min_by("path", F.struct("_rank", "path")))


def map_folders(files: DataFrame, prefix: str = "M", contains: str = "") -> DataFrame:
    """(folder) of maps, in order."""
    return files.select("folder").distinct().filter(F.col("folder").startswith(prefix) & F.col("folder").contains(contains)).orderBy("folder")


def series_folders(files: DataFrame, prefix: str) -> DataFrame:
    """(series): folders of the second level above the files, by their prefix."""
    return files.select(F.regexp_extract("path", r"([^/]*)/[^/]*/[^/]*$", 1).alias("series")).distinct().filter(F.col("series").startswith(prefix)).orderBy("series")


def located(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assets (map_id, series, ...) of the wanted maps, of the first series that has the map."""
    w = Window.partitionBy("map_id").orderBy("series")
    return found.join(wanted.select("map_id").distinct(), "map_id", "left_semi").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def inputs(files: DataFrame) -> DataFrame:
    """(folder_path, image, mode): a folder with an image, the best of its images, and ``auto`` where a world file is beside it, else ``bootstrap``."""
    rows = files.withColumn("folder_path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    rank = _rank(F.col("extension"), IMAGES)
    got = rows.groupBy("folder_path").agg(F.min_by(F.when(rank > 0, F.col("path")), F.when(rank > 0, F.struct(rank, F.col("path")))).alias("image"), F.max(F.col("extension").isin(*KINDS["tfwx"])).alias("_world"))
    return got.filter("image IS NOT NULL").select("folder_path", "image", F.when(F.col("_world"), "auto").otherwise("bootstrap").alias("mode"))


def crops(files: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Crop files (png, or jpg where a folder has no png), in order of name; with ``sample`` so many, by a hash of the name."""
    rows = files.filter("extension IN ('png', 'jpg')").withColumn("_png", F.max(F.col("extension") == "png").over(Window.partitionBy("folder")))
    rows = rows.filter("extension = 'png' OR NOT _png").drop("_png")
    if sample is not None:
        rows = rows.orderBy(F.xxhash64("file_name", F.lit(seed)), "path").limit(sample)
    return rows.orderBy("file_name", "path")


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, height, width, channels, data): pixels row by row, blue, green, red; files that can't be decoded have no row.

    A scan is a large row: cut it into tiles before any shuffle."""
    return spark.read.format("image").option("dropInvalid", True).load(list(paths)).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def image_sizes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, width, height, dpi) from the headers of PNG, JPEG and TIFF files; nulls where they aren't told."""
    @F.pandas_udf("struct<width: int, height: int, dpi: double>")
    def header(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_header(c) for c in content], columns=["width", "height", "dpi"])

    rows = spark.read.format("binaryFile").load(list(paths))
    return rows.select("path", header("content").alias("h")).select("path", "h.width", "h.height", "h.dpi")


def image_header(data: bytes) -> tuple[int | None, int | None, float | None]:
    """(width, height, dpi) from the first bytes of an image."""
    import struct

    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height = struct.unpack(">II", data[16:24])
        at, dpi = 8, None
        while at + 8 <= len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            if name == b"pHYs":
                per, _, unit = struct.unpack(">IIB", data[at + 8 : at + 17])
                dpi = per * 0.0254 if unit == 1 else None
            if name in (b"IDAT", b"IEND"):
                break
            at += 12 + size
        return width, height, dpi
    if data[:2] == b"\xff\xd8":
        at, dpi = 2, None
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if mark == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0":
                unit, per = data[at + 11], struct.unpack(">H", data[at + 12 : at + 14])[0]
                dpi = per * {1: 1.0, 2: 2.54}.get(unit, 0) or None
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height, dpi
            at += 2 + size
        return None, None, dpi
    if data[:4] in (b"II*\0", b"MM\0*"):
        e = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(e + "I", data[4:8])[0]
        tags = {}
        for k in range(struct.unpack(e + "H", data[at : at + 2])[0]):
            tag, kind, _, raw = struct.unpack(e + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
            value = struct.unpack(e + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
            tags[tag] = value
        dpi = None
        if tags.get(282) and tags[282] + 8 <= len(data):
            n, d = struct.unpack(e + "II", data[tags[282] : tags[282] + 8])
            dpi = n / d * (2.54 if tags.get(296) == 3 else 1.0) if d else None
        return tags.get(256), tags.get(257), dpi
    return None, None, None
