"""Range joins, nearest neighbours and greedy spatial selection.

Boxes and radii become equi-joins on grid bins with the exact predicate as a
residual, so Spark can hash them; a plain theta join would compare all rows.
"""

from __future__ import annotations

from math import hypot

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_join(points: DataFrame, boxes: DataFrame, x: str, y: str, margin: float = 0.0, *, bin_size: float, key: str = "map_id") -> DataFrame:
    """Points inside each closed box (min_x, max_x, min_y, max_y) widened by ``margin``.

    A point has one bin of side ``bin_size`` and a box as many as it covers, and
    the join is on bins: choose about a box's side (``box_side`` measures it).
    Columns of both sides stay, the boxes' bounds and the bins go."""
    inside = F.col(x).between(F.col("min_x") - margin, F.col("max_x") + margin) & F.col(y).between(F.col("min_y") - margin, F.col("max_y") + margin)

    def cell(c: Column) -> Column:
        return F.floor(c / bin_size).cast("long")

    def cells(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(cell(F.col(lo) - margin), cell(F.col(hi) + margin)))

    ok = boxes.filter((F.col("min_x") <= F.col("max_x") + 2 * margin) & (F.col("min_y") <= F.col("max_y") + 2 * margin))
    spread = ok.withColumn("_bx", cells("min_x", "max_x")).withColumn("_by", cells("min_y", "max_y"))
    binned = points.withColumn("_bx", cell(F.col(x))).withColumn("_by", cell(F.col(y)))
    return binned.join(spread, ["_bx", "_by"]).filter(inside).drop("_bx", "_by", "min_x", "max_x", "min_y", "max_y")


def box_side(boxes: DataFrame, margin: float = 0.0) -> float:
    """A bin size for ``box_join``: the median of the boxes' longer sides with their margins, 1.0 where there is none.  One aggregation over the boxes."""
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) + 2 * margin
    found = boxes.agg(F.percentile_approx(side, 0.5)).first()[0]
    return float(found) if found and found > 0 else 1.0


def in_frame(px: Column, py: Column, half: Column, width: Column, height: Column) -> Column:
    """Whether a window of ``half`` pixels around the rounded position fits: closed at 0, open at the far side."""
    c, r = F.rint(px), F.rint(py)
    return (c - half >= 0) & (r - half >= 0) & (c + half < width) & (r + half < height)


def strictly_inside(px: Column, py: Column, width: Column, height: Column) -> Column:
    return (px >= 0) & (py >= 0) & (px < width) & (py < height)


def within_box(px: Column, py: Column, box: Column, margin: float) -> Column:
    """Whether a point lies in a (top, bottom, left, right) box widened by ``margin``."""
    return px.between(box["left"] - margin, box["right"] + margin) & py.between(box["top"] - margin, box["bottom"] + margin)


def in_grid_or_neatline(px: Column, py: Column, grid: Column, neatline: Column) -> Column:
    """Inside the grid's bounds (15 px wider) where known, else the neatline's (30 px wider), else anywhere."""
    return F.when(grid.isNotNull(), within_box(px, py, grid, 15)).when(neatline.isNotNull(), within_box(px, py, neatline, 30)).otherwise(F.lit(True))


def in_content(px: Column, py: Column, width: Column, height: Column, margin: int = 100, bottom: float = 0.13) -> Column:
    """Inside the border and above the legend."""
    return (px >= margin) & (px < width - margin) & (py >= margin) & (py < F.least(height - margin, F.floor(height * (1 - bottom))))


def _cells(df: DataFrame, x: str, y: str, radius: float, near: bool) -> DataFrame:
    """Cells of side ``radius``; with ``near`` the nine around each point."""
    cx, cy = F.floor(F.col(x) / radius).cast("long"), F.floor(F.col(y) / radius).cast("long")
    if not near:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    around = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_c", F.explode(around)).withColumn("_cx", F.col("_c.cx")).withColumn("_cy", F.col("_c.cy")).drop("_c")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, key: str = "map_id", strict: bool = True) -> DataFrame:
    """All pairs of rows of one map nearer than ``radius`` (at most, if not ``strict``), with their ``distance``.

    ``left`` has px, py; ``right`` has qx, qy.  Only rows of neighbouring cells meet."""
    spread = _cells(left, "px", "py", radius, near=True)
    binned = _cells(right, "qx", "qy", radius, near=False)
    joined = spread.join(binned, [key, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("distance", F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")))
    return joined.filter(F.col("distance") < radius if strict else F.col("distance") <= radius)


def match_nearest(detections: DataFrame, truth: DataFrame, radius: float = 30.0, one_to_one: bool = True) -> DataFrame:
    """Each detection's nearest truth, if nearer than ``radius``: map_id, det, gt, distance.

    detections: map_id, det (rank by confidence, unique in a map), px, py; truth:
    map_id, gt, qx, qy.  Of equally near truths the least gt counts.  One to one,
    a truth goes to the first detection that has it nearest; a detection that
    comes too late isn't matched to another."""
    near = pairs_within(detections, truth, radius).groupBy("map_id", "det").agg(F.min(F.struct("distance", "gt")).alias("_m"))
    near = near.select("map_id", "det", F.col("_m.gt").alias("gt"), F.col("_m.distance").alias("distance"))
    if not one_to_one:
        return near
    first = Window.partitionBy("map_id", "gt").orderBy("det")
    return near.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def near_any(candidates: DataFrame, truth: DataFrame, radius: float, anti: bool = False, strict: bool = True) -> DataFrame:
    """Candidates (map_id, id, px, py, ...) with a truth (map_id, qx, qy) within ``radius``; with ``anti`` those without."""
    hit = pairs_within(candidates.select("map_id", "id", "px", "py"), truth.select("map_id", "qx", "qy"), radius, strict=strict).select("map_id", "id").distinct()
    return candidates.join(hit, ["map_id", "id"], "left_anti" if anti else "left_semi")


def select_spread(rows: DataFrame, order: list[str], carry: list[str], n: int | None = 15, distance: float = 200.0, strict: bool = False, key: str = "map_id") -> DataFrame:
    """Greedy thinning of each map: in the order of ``order`` (ascending; negate scores) a row stays if it is at
    least ``distance`` (more, if ``strict``) from all that stay, until ``n`` do.

    rows have px, py; a row without a position is left out.  Result: the key,
    ``pick`` (from 1) and the ``carry`` columns.  A map's rows are in one task, as
    Arrow columns of what is named here; what stays is kept by cells of side
    ``distance``, so a row is compared with the few in the nine cells around it."""
    import pyarrow as pa

    names = list(dict.fromkeys([key, "px", "py", *order, *carry]))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {'int' if c == 'pick' else kinds[c]}" for c in (key, "pick", *carry))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        keep: list[int] = []
        for i, (x, y) in enumerate(zip(table["px"].to_pylist(), table["py"].to_pylist(), strict=True)):
            if n is not None and len(keep) >= n:
                break
            cx, cy = int(x // distance), int(y // distance)
            seen = (k for u in (cx - 1, cx, cx + 1) for v in (cy - 1, cy, cy + 1) for k in cells.get((u, v), ()))
            if all((hypot(x - u, y - v) > distance) if strict else (hypot(x - u, y - v) >= distance) for u, v in seen):
                cells.setdefault((cx, cy), []).append((x, y))
                keep.append(i)
        out = table.take(keep)
        return pa.table({key: out[key], "pick": pa.array(range(1, len(keep) + 1), pa.int32()), **{c: out[c] for c in carry}})

    return rows.filter("px IS NOT NULL AND py IS NOT NULL").select(*names).groupBy(key).applyInArrow(run, schema)


def suppress(rows: DataFrame, order: list[str], carry: list[str], distance: float = 20.0, key: str = "map_id") -> DataFrame:
    """Non-maximum suppression: rows in order, each dropped if strictly nearer than ``distance`` to one that stays."""
    return select_spread(rows, order, carry, None, distance, key=key)


def thin_new(candidates: DataFrame, existing: DataFrame, radius: float = 10.0) -> DataFrame:
    """New positions that are farther than ``radius`` from all existing ones and, in order of id, from the new ones before.

    candidates: map_id, id, px, py; existing: map_id, qx, qy."""
    fresh = near_any(candidates, existing, radius, anti=True, strict=False)
    return select_spread(fresh, ["id"], ["id", "px", "py"], None, radius, strict=True)


def match_by_name_or_height(readings: DataFrame, points: DataFrame) -> DataFrame:
    """readings (id, name, height) joined with points (pid, name, height double): by name, where the last pid of a
    name counts; else by height within 1.0 in steps of 0.1, if all that fit have one name: id, pid, matched_by."""
    named = points.groupBy("name").agg(F.max("pid").alias("pid"))
    by_name = readings.join(named, "name").select("id", "pid", F.lit("name").alias("matched_by"))
    rest = readings.join(by_name, "id", "left_anti").filter("height IS NOT NULL").withColumn("_h", F.rint(F.col("height") * 10).cast("long"))
    near = rest.withColumn("_h", F.explode(F.sequence(F.col("_h") - 10, F.col("_h") + 10)))
    keyed = points.filter("height IS NOT NULL").select("pid", F.col("name").alias("_name"), F.rint(F.col("height") * 10).cast("long").alias("_h"))
    hit = near.join(keyed, "_h").groupBy("id").agg(F.max("pid").alias("pid"), F.count_distinct("_name").alias("_n")).filter("_n = 1")
    return by_name.unionByName(hit.select("id", "pid", F.lit("height").alias("matched_by")))


def round_robin(rows: DataFrame, order: list[str], n: int, key: str = "map_id") -> DataFrame:
    """The first ``n`` rows taken one from each map in turn, with ``turn``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", key).limit(n)


def top_of_each(rows: DataFrame, order: list[Column], n: int | None, key: str = "map_id") -> DataFrame:
    """The first ``n`` rows of each map (all for None), with ``rank``."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def neighbour_pairs(rows: DataFrame, cell: float, key: str = "map_id") -> DataFrame:
    """Pairs of rows (id, px, py) of a map, the lower id first, whose cells touch."""
    left = _cells(rows.select(key, "id", "px", "py"), "px", "py", cell, near=True)
    right = _cells(rows.select(key, F.col("id").alias("other"), F.col("px").alias("qx"), F.col("py").alias("qy")), "qx", "qy", cell, near=False)
    return left.join(right, [key, "_cx", "_cy"]).filter("id < other").drop("_cx", "_cy")
