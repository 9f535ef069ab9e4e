"""Facts kept in file names: sheet numbers, crop positions, map ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of sheet names: one sheet, two columns joined, two rows joined.
SHEETS = (r"^(\d{2})-(\d{2})-", r"^(\d{2})(\d{2})-(\d{2})-", r"^(\d{2})-(\d{2})(\d{2})-")
CROP = r"^(.*)_x(-?\d+)_y(-?\d+)(?:_c([\d.]+))?(?:_([A-Za-z]+))?\.png$"


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def sheet_ranges(file_name: Column) -> Column:
    """(old_e_min, old_e_max, old_n_min, old_n_max) in metres of the sheet that a file name tells, else null."""
    s = stem(file_name)

    def part(pattern: int, group: int) -> Column:
        return F.try_to_number(F.regexp_extract(s, SHEETS[pattern], group), F.lit("99")).cast("long")

    one, columns, rows = (s.rlike(p) for p in SHEETS)
    left = F.when(one, part(0, 1)).when(columns, F.least(part(1, 1), part(1, 2))).when(rows, part(2, 1))
    right = F.when(one, part(0, 1)).when(columns, F.greatest(part(1, 1), part(1, 2))).when(rows, part(2, 1))
    low = F.when(one, part(0, 2)).when(columns, part(1, 3)).when(rows, F.least(part(2, 2), part(2, 3)))
    high = F.when(one, part(0, 2)).when(columns, part(1, 3)).when(rows, F.greatest(part(2, 2), part(2, 3)))
    box = F.struct((low * 10_000 + 1_000_000).alias("old_e_min"), ((high + 1) * 10_000 + 1_000_000).alias("old_e_max"), (left * 10_000).alias("old_n_min"), ((right + 1) * 10_000).alias("old_n_max"))
    return F.when(one | columns | rows, box)


def label_ranges(file_name: Column, slack_km: int = 1) -> Column:
    """(easting_lo, easting_hi, northing_lo, northing_hi) in km that a sheet's labels can have, else null."""
    r = sheet_ranges(file_name)
    km = F.lit(1000)
    box = F.struct(
        (F.floor(r["old_n_min"] / km) - slack_km).alias("easting_lo"),
        (F.floor(r["old_n_max"] / km) + slack_km).alias("easting_hi"),
        (F.floor((r["old_e_min"] - 1_000_000) / km) - slack_km).alias("northing_lo"),
        (F.floor((r["old_e_max"] - 1_000_000) / km) + slack_km).alias("northing_hi"),
    )
    return F.when(r.isNotNull(), box)


def crop(file_name: Column) -> Column:
    """(map_id, x, y, confidence, tag) of a crop's file name; null where it isn't one."""
    got = [F.nullif(F.regexp_extract(file_name, CROP, i), F.lit("")) for i in range(1, 6)]
    box = F.struct(got[0].alias("map_id"), got[1].cast("long").alias("x"), got[2].cast("long").alias("y"), got[3].try_cast("double").alias("confidence"), got[4].alias("tag"))
    return F.when(file_name.rlike(CROP), box)


def crop_confidence(file_name: Column) -> Column:
    """The confidence at the end of a crop's name, 1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, r"_c([\d.]+)\.png$", 1), F.lit("")).try_cast("double"), F.lit(1.0))


def held_out_map(file_name: Column, held_out: list[str]) -> Column:
    """Which held-out map a crop belongs to (by the prefix ``<id>_``), else null."""
    return F.coalesce(*[F.when(file_name.startswith(m + "_"), F.lit(m)) for m in held_out], F.lit(None).cast("string"))


def point_name(text: Column) -> Column:
    """Point names as read: ``12A`` stands for ``12/A``; others stay."""
    return F.regexp_replace(text, r"^(\d{1,4})([A-Z])$", "$1/$2")


def point_height(text: Column, confidence: Column) -> Column:
    """A height between 0 and 2000 that was read with confidence over 0.2, else null."""
    h = text.try_cast("double")
    return F.when((confidence > 0.2) & (h > 0) & (h < 2000), h)
