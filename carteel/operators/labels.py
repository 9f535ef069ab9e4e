"""Repair, validation and fitting of grid labels.

A label is (map_id, axis, id, pos, val, conf): where it was read, its value in
km and its confidence; ``id`` orders the labels of a series.  Series have a few
dozen labels, so pairs of one series are cheap and everything is keyed by it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.labels import CONFUSED

SPACING = (500.0, 2500.0)
SERIES = ["map_id", "axis"]


def _pairs(labels: DataFrame, ordered: bool) -> DataFrame:
    """Pairs of labels of a series (i before j if ``ordered``) with their rate in px per km, null for equal values."""
    i = labels.select(*SERIES, *[F.col(c).alias(f"{c}_i") for c in ("id", "pos", "val")])
    j = labels.select(*SERIES, *[F.col(c).alias(f"{c}_j") for c in ("id", "pos", "val")])
    pairs = i.join(j, SERIES).filter("id_i < id_j" if ordered else "id_i <> id_j")
    return pairs.withColumn("rate", (F.col("pos_j") - F.col("pos_i")) / F.nullif((F.col("val_j") - F.col("val_i")).cast("double"), F.lit(0.0)))


def plausible(rate: Column, spacing: tuple[float, float] = SPACING) -> Column:
    return F.abs(rate).between(*spacing)


def pair_rates(labels: DataFrame, spacing: tuple[float, float] = SPACING) -> DataFrame:
    """Pairs with a plausible rate."""
    return _pairs(labels, True).filter(plausible(F.col("rate"), spacing))


def validate_sequence(labels: DataFrame, spacing: tuple[float, float] = SPACING, tolerance: float = 0.30) -> DataFrame:
    """Labels whose distance to at least one other fits the series' median signed rate.

    A single label passes; a series without any plausible rate keeps none."""
    median = pair_rates(labels, spacing).groupBy(*SERIES).agg(F.median("rate").alias("_rate"))
    fit = _pairs(labels, False).filter("val_i <> val_j").join(median, SERIES)
    expected = (F.col("val_j") - F.col("val_i")) * F.col("_rate")
    error = F.abs((F.col("pos_j") - F.col("pos_i")) - expected) / F.abs(expected)
    good = fit.filter(error < tolerance).select(*SERIES, F.col("id_i").alias("id")).distinct()
    alone = labels.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n")).filter("_n < 2").drop("_n")
    return labels.join(good, [*SERIES, "id"], "left_semi").unionByName(labels.join(alone, SERIES, "left_semi"))


def sequence_score(labels: DataFrame, spacing: tuple[float, float] = SPACING) -> DataFrame:
    """(map_id, axis, score): 1 for each plausible step, half for a step of 1 km, and up to 2 for even spacing."""
    w = Window.partitionBy(*SERIES).orderBy("id")
    step = labels.withColumn("_dv", F.col("val") - F.lag("val").over(w)).withColumn("_dp", F.col("pos") - F.lag("pos").over(w))
    rate = F.abs(F.col("_dp") / F.nullif(F.col("_dv").cast("double"), F.lit(0.0)))
    step = step.withColumn("_r", F.when(rate.between(*spacing), rate))
    got = step.groupBy(*SERIES).agg(
        F.count("_r").alias("_n"),
        F.count(F.when(F.col("_r").isNotNull() & (F.abs("_dv") == 1), 1)).alias("_ones"),
        (F.stddev_pop("_r") / F.avg("_r")).alias("_cv"),
    )
    even = F.when((F.col("_n") >= 2) & (F.col("_cv") < 0.1), 2.0).when((F.col("_n") >= 2) & (F.col("_cv") < 0.2), 1.0).otherwise(0.0)
    return got.select(*SERIES, (F.col("_n") + F.col("_ones") * 0.5 + even).alias("score"))


def merge_edges(labels: DataFrame, spread: float = 150.0) -> DataFrame:
    """One label for each value of a series (labels have ``edge`` as well): the mean position and best confidence, edge
    ``both`` for several readings; where positions are more than ``spread`` apart, the reading with the best confidence (the first of equals)."""
    best = F.max_by(F.struct("pos", "conf", "edge"), F.struct(F.col("conf"), -F.col("id")))
    got = labels.groupBy(*SERIES, "val").agg(best.alias("_best"), (F.max("pos") - F.min("pos")).alias("_spread"), F.avg("pos").alias("_pos"), F.max("conf").alias("_conf"), F.count(F.lit(1)).alias("_n"), F.min("edge").alias("_edge"))
    torn = F.col("_spread") > spread
    return got.select(
        *SERIES,
        F.when(torn, F.col("_best.pos")).otherwise(F.col("_pos")).alias("pos"),
        "val",
        F.when(torn, F.col("_best.conf")).otherwise(F.col("_conf")).alias("conf"),
        F.when(torn, F.col("_best.edge")).when(F.col("_n") == 1, F.col("_edge")).otherwise("both").alias("edge"),
    )


def consensus(labels: DataFrame, spacing: tuple[float, float] = SPACING, tolerance_km: float = 0.25, least: int = 3) -> DataFrame:
    """The largest set of a series' labels on one line through two of them; of equal sets the tighter, then the first.

    Series with fewer than ``least`` labels, or no such line, go to ``remove_non_monotonic``."""
    lines = pair_rates(labels, spacing).withColumn("_at", F.col("pos_i") - F.col("rate") * F.col("val_i")).select(*SERIES, "id_i", "id_j", "rate", "_at")
    off = F.abs(F.col("pos") - (F.col("rate") * F.col("val") + F.col("_at")))
    hits = lines.join(labels, SERIES).withColumn("_off", off).filter(F.col("_off") <= tolerance_km * F.abs("rate"))
    scored = hits.groupBy(*SERIES, "id_i", "id_j", "rate", "_at").agg(F.count(F.lit(1)).alias("_n"), F.sum("_off").alias("_sum")).filter(F.col("_n") >= least)
    first = Window.partitionBy(*SERIES).orderBy(F.desc("_n"), "_sum", "id_i", "id_j")
    line = scored.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select(*SERIES, "rate", "_at")
    kept = labels.join(line, SERIES).filter(off <= tolerance_km * F.abs("rate")).drop("rate", "_at")
    rest = labels.join(line, SERIES, "left_anti")
    return kept.unionByName(remove_non_monotonic(rest))


def _violators(val: np.ndarray, conf: np.ndarray) -> np.ndarray:
    """Which labels stay when the worst offender against the series' direction goes, again and again."""
    alive = np.arange(len(val))
    if len(val) < 3:
        return alive
    up = np.sign(np.diff(val)).sum() > 0
    for _ in range(len(val) // 2):
        v = val[alive]
        ahead = v[None, :] - v[:, None]  # later minus earlier above the diagonal
        wrong = np.triu((ahead <= 0) if up else (ahead >= 0), 1)
        count = wrong.sum(axis=0) + wrong.sum(axis=1)
        worst = np.lexsort((np.arange(len(alive)), conf[alive], -count))[0]
        if not count[worst]:
            break
        alive = np.delete(alive, worst)
    return alive


def _each_series(labels: DataFrame, pick) -> DataFrame:
    """Runs ``pick(table) -> table`` on each series in order of id."""

    def run(table):
        return pick(table.sort_by("id"))

    return labels.groupBy(*SERIES).applyInArrow(run, labels.schema)


def remove_non_monotonic(labels: DataFrame) -> DataFrame:
    """Drop labels out of order with most others until the series is monotonic; of equals the least confident goes.  At most half of the labels go."""
    return _each_series(labels, lambda t: t.take(_violators(t["val"].to_numpy().astype(float), t["conf"].to_numpy().astype(float))))


def _score(val: list[int], pos: np.ndarray, spacing: tuple[float, float]) -> float:
    dv = np.diff(np.asarray(val, float))
    ok = dv != 0
    rate = np.abs(np.diff(pos)[ok] / dv[ok])
    good = (rate >= spacing[0]) & (rate <= spacing[1])
    score = good.sum() + 0.5 * (np.abs(dv[ok])[good] == 1).sum()
    if good.sum() >= 2:
        cv = rate[good].std() / rate[good].mean()
        score += 2.0 if cv < 0.1 else 1.0 if cv < 0.2 else 0.0
    return float(score)


def _swapped(v: int) -> list[int]:
    text = str(v)
    return [int(text[:i] + s + text[i + 1 :]) for i, c in enumerate(text) for s in CONFUSED.get(c, ())]


def repaired_values(val: list[int], pos: np.ndarray, spacing: tuple[float, float] = SPACING) -> list[int]:
    """Values after folding the two commonest decades into one, if they differ in one digit and that scores better,
    and then exchanging single digits as long as the score rises."""
    if len(val) < 3:
        return val
    best, top = list(val), _score(val, pos, spacing)
    if all(50 <= v <= 300 for v in val):
        decades = [d for d, _ in Counter(v // 10 for v in val).most_common(2)]
        if len(decades) == 2:
            for source, goal in (decades[::-1], decades):
                a, b = str(source), str(goal)
                if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                    folded = [goal * 10 + v % 10 if v // 10 == source else v for v in val]
                    if (score := _score(folded, pos, spacing)) > top:
                        best, top = folded, score
    moving = True
    while moving:
        moving = False
        for i in range(len(best)):
            now = _score(best, pos, spacing)
            for v in _swapped(best[i]):
                if v != best[i] and _score([*best[:i], v, *best[i + 1 :]], pos, spacing) > now:
                    best[i], moving = v, True
                    break
    return best


def repair_digits(labels: DataFrame, spacing: tuple[float, float] = SPACING) -> DataFrame:
    """Labels with misread digits repaired; a changed value costs a tenth of the confidence.  Fewer than three pass."""

    def fix(table):
        import pyarrow as pa

        old = table["val"].to_pylist()
        new = repaired_values(old, table["pos"].to_numpy().astype(float), spacing)
        conf = [c if a == b else c * 0.9 for c, a, b in zip(table["conf"].to_pylist(), old, new, strict=True)]
        names = table.column_names
        table = table.set_column(names.index("val"), "val", pa.array(new, table["val"].type))
        return table.set_column(names.index("conf"), "conf", pa.array(conf, table["conf"].type))

    return _each_series(labels, fix)


def fit_lines(labels: DataFrame, rounds: int = 5) -> DataFrame:
    """The labels that a robust line val = slope*pos + offset keeps, with its ``slope`` and ``offset`` (km).

    Each round fits the kept labels and keeps those nearer than
    max(median + 3*max(MAD, 0.5), 2) km; it ends when nothing changes or fewer than two would stay."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, y = table["pos"].to_numpy().astype(float), table["val"].to_numpy().astype(float)
        keep = np.ones(len(x), bool)

        def fitted() -> tuple[float, float]:
            m = x[keep].mean()
            d = x[keep] - m
            s = float((d * (y[keep] - y[keep].mean())).sum() / (d * d).sum()) if (d * d).sum() > 0 else 0.0
            return s, float(y[keep].mean() - s * m)

        for _ in range(rounds):
            s, o = fitted()
            off = np.abs(y - (s * x + o))
            mid = np.median(off[keep])
            fresh = off < max(mid + 3 * max(np.median(np.abs(off[keep] - mid)), 0.5), 2.0)
            if fresh.sum() < 2 or (fresh == keep).all():
                break
            keep = fresh
        s, o = fitted()
        out = table.filter(pa.array(keep))
        return out.append_column("slope", pa.array([s] * len(out))).append_column("offset", pa.array([o] * len(out)))

    schema = StructType([*labels.schema.fields, StructField("slope", DoubleType()), StructField("offset", DoubleType())])
    return labels.groupBy(*SERIES).applyInArrow(run, schema)


def label_affine(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transforms, labels used) from labels of the axes ``easting`` (positions are columns) and ``northing`` (rows).

    A row for each map: a..f (b = c = 0), pixel sizes, RMSE of each axis in
    metres, counts, and ``reject_reason``, null for a sound fit."""
    enough = labels.groupBy("map_id").agg(F.count(F.when(F.col("axis") == "easting", 1)).alias("_e"), F.count(F.when(F.col("axis") == "northing", 1)).alias("_n"))
    agreed = consensus(labels.join(enough.filter("_e >= 2 AND _n >= 2").select("map_id"), "map_id", "left_semi"))
    used = fit_lines(agreed)
    before = agreed.groupBy("map_id").pivot("axis", ["easting", "northing"]).agg(F.count(F.lit(1))).select("map_id", F.coalesce("easting", F.lit(0)).alias("n_easting"), F.coalesce("northing", F.lit(0)).alias("n_northing"))
    off = (F.col("val") - (F.col("slope") * F.col("pos") + F.col("offset"))) * 1000.0
    lines = used.groupBy("map_id").pivot("axis", ["easting", "northing"]).agg(F.first("slope").alias("slope"), F.first("offset").alias("offset"), F.sqrt(F.avg(off * off)).alias("rmse"))
    t = enough.join(before, "map_id", "left").join(lines, "map_id", "left")
    a, d = F.col("easting_slope") * 1000.0, F.col("northing_slope") * 1000.0
    sx, sy = F.abs(a), F.abs(d)
    reason = (
        F.when((F.col("_e") < 2) | (F.col("_n") < 2), "too few labels")
        .when((F.coalesce("n_easting", F.lit(0)) < 2) | (F.coalesce("n_northing", F.lit(0)) < 2), "too few labels agree")
        .when(~sx.between(0.3, 10.0) | ~sy.between(0.3, 10.0), "pixel size")
        .when(F.greatest(sx, sy) > 3.0 * F.least(sx, sy), "pixel size ratio")
        .when((F.col("easting_rmse") > 1000) | (F.col("northing_rmse") > 1000), "residuals")
    )
    transforms = t.select(
        "map_id",
        a.alias("a"),
        F.lit(0.0).alias("b"),
        F.lit(0.0).alias("c"),
        d.alias("d"),
        (F.col("easting_offset") * 1000.0).alias("e"),
        (F.col("northing_offset") * 1000.0).alias("f"),
        sx.alias("pixel_size_x"),
        sy.alias("pixel_size_y"),
        F.col("easting_rmse").alias("easting_rmse_m"),
        F.col("northing_rmse").alias("northing_rmse_m"),
        F.coalesce("n_easting", F.lit(0)).alias("n_easting"),
        F.coalesce("n_northing", F.lit(0)).alias("n_northing"),
        F.lit("old_grid").alias("coordinate_system"),
        reason.alias("reject_reason"),
    )
    return transforms, used.drop("slope", "offset")


def grid_points(labels: DataFrame, transforms: DataFrame, neatlines: DataFrame) -> DataFrame:
    """(map_id, axis, id, pixel_x, pixel_y, old_e, old_n): a point on the neatline for each label, the other axis by the label transform.

    Labels have ``edge``; of eastings all but ``top`` lie on the bottom, of northings all but ``left`` on the right."""
    rows = labels.join(transforms.select("map_id", "a", "d", "e", "f"), "map_id").join(neatlines.select("map_id", "top", "bottom", "left", "right"), "map_id")
    east = F.col("axis") == "easting"
    px = F.when(east, F.col("pos")).otherwise(F.when(F.col("edge") == "left", F.col("left")).otherwise(F.col("right")).cast("double"))
    py = F.when(east, F.when(F.col("edge") == "top", F.col("top")).otherwise(F.col("bottom")).cast("double")).otherwise(F.col("pos"))
    rows = rows.withColumn("pixel_x", px).withColumn("pixel_y", py)
    km = F.col("val") * 1000.0
    old_n = F.when(east, km).otherwise(F.col("a") * F.col("pixel_x") + F.col("e"))
    old_e = F.when(east, F.col("d") * F.col("pixel_y") + F.col("f") + 1_000_000).otherwise(km + 1_000_000)
    return rows.select("map_id", "axis", "id", "pixel_x", "pixel_y", old_e.alias("old_e"), old_n.alias("old_n"))


def sheet_points(sheets: DataFrame) -> DataFrame:
    """Grid points for maps without readable labels: the neatline's corners at the sheet's ranges.

    sheets: map_id, top, bottom, left, right, old_e_min, old_e_max, old_n_min, old_n_max."""
    corner = F.array(*[F.struct(F.col(px).cast("double").alias("pixel_x"), F.col(py).cast("double").alias("pixel_y"), F.col(oe).cast("double").alias("old_e"), F.col(on).cast("double").alias("old_n")) for px, on in (("left", "old_n_min"), ("right", "old_n_max")) for py, oe in (("top", "old_e_max"), ("bottom", "old_e_min"))])
    return sheets.select("map_id", F.inline(corner))


def label_extent(labels: DataFrame, margin: float = 1000.0) -> DataFrame:
    """(map_id, old_e_min, old_e_max, old_n_min, old_n_max) in metres that the labels cover."""
    east, north = F.when(F.col("axis") == "easting", F.col("val") * 1000.0), F.when(F.col("axis") == "northing", F.col("val") * 1000.0 + 1_000_000)
    return labels.groupBy("map_id").agg((F.min(north) - margin).alias("old_e_min"), (F.max(north) + margin).alias("old_e_max"), (F.min(east) - margin).alias("old_n_min"), (F.max(east) + margin).alias("old_n_max"))


def cluster_lines(positions: DataFrame, gap: int = 3, keys: tuple[str, ...] = ("map_id",)) -> DataFrame:
    """(keys, line): positions (``pos``, integers) no more than ``gap`` from their neighbour make one line, at their mean cut to an integer."""
    w = Window.partitionBy(*keys).orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(w) > gap, 1).otherwise(0)
    islands = positions.withColumn("_new", fresh).withColumn("_c", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_c").agg(F.avg("pos").cast("int").alias("line")).drop("_c")


def regular_lines(lines: DataFrame, least: int = 3, keys: tuple[str, ...] = ("map_id",)) -> DataFrame:
    """The lines (``line``) at about even distances: a line stays if it is 0.5 to 1.5 median spacings from the last that stays, or near a
    multiple.  Groups with fewer than ``least`` such lines, or a median spacing under 50, keep all."""
    all_ = F.sort_array(F.collect_list("line"))
    got = lines.groupBy(*keys).agg(all_.alias("_l"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_l") - 1), lambda i: F.get("_l", i) - F.get("_l", i - 1))
    got = got.withColumn("_d", F.when(F.size("_l") > 1, F.sort_array(steps)))
    n = F.size("_d")
    got = got.withColumn("_m", (F.get("_d", F.floor((n - 1) / 2).cast("int")) + F.get("_d", F.floor(n / 2).cast("int"))) / 2.0)

    def step(acc: Column, x: Column) -> Column:
        s = x - F.element_at(acc, -1)
        turns = F.rint(s / F.col("_m"))
        near = s.between(F.col("_m") * 0.5, F.col("_m") * 1.5)
        far = (s > F.col("_m") * 1.5) & (turns >= 1) & (F.abs(s / F.greatest(turns, F.lit(1.0)) - F.col("_m")) / F.col("_m") < 0.3)
        return F.when(near | far, F.array_append(acc, x)).otherwise(acc)

    good = F.aggregate(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))), F.slice("_l", 1, 1), step)
    got = got.withColumn("_g", F.when((F.size("_l") >= least) & (F.col("_m") >= 50), good).otherwise(F.col("_l")))
    return got.select(*keys, F.explode(F.when(F.size("_g") >= least, F.col("_g")).otherwise(F.col("_l"))).alias("line"))


def adaptive_lines(profile: DataFrame, thresholds: tuple[float, ...] = (0.25, 0.22, 0.20, 0.18, 0.15)) -> DataFrame:
    """(map_id, axis, line): regular lines at the highest threshold that yields three.

    profile: map_id, axis, pos, dark (share of dark pixels), lo, hi (the neatline, whose neighbourhood of 30 px doesn't count)."""
    levels = profile.withColumn("level", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("dark") > F.col("level"))
    keys = ("map_id", "axis", "level")
    lines = cluster_lines(levels, 5, keys)
    frame = profile.groupBy("map_id", "axis").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    lines = lines.join(frame, ["map_id", "axis"]).filter("line > lo + 30 AND line < hi - 30").drop("lo", "hi")
    regular = regular_lines(lines, keys=keys)
    chosen = regular.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3").groupBy("map_id", "axis").agg(F.max("level").alias("level"))
    return regular.join(chosen, list(keys), "left_semi").drop("level")


def grid_bounds(lines: DataFrame, neatlines: DataFrame) -> DataFrame:
    """(map_id, top, bottom, left, right, h_lines, v_lines) from lines (axis ``h`` or ``v``); maps with fewer than two lines on
    an axis, or less than half of the neatline covered, have none."""
    got = lines.groupBy("map_id").pivot("axis", ["h", "v"]).agg(F.sort_array(F.collect_list("line")).alias("l"), F.count(F.lit(1)).alias("n"))
    h, v = (F.col("h_l"), F.col("v_l")) if "h_l" in got.columns else (F.col("h"), F.col("v"))
    got = got.filter((F.size(h) >= 2) & (F.size(v) >= 2)).select("map_id", F.array_min(h).alias("g_top"), F.array_max(h).alias("g_bottom"), F.array_min(v).alias("g_left"), F.array_max(v).alias("g_right"), h.alias("h_lines"), v.alias("v_lines"))
    wide = (F.col("g_bottom") - F.col("g_top") >= (F.col("bottom") - F.col("top")) * 0.5) & (F.col("g_right") - F.col("g_left") >= (F.col("right") - F.col("left")) * 0.5)
    return got.join(neatlines, "map_id").filter(wide).select("map_id", *[F.col(f"g_{k}").alias(k) for k in ("top", "bottom", "left", "right")], "h_lines", "v_lines")


def neatline(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(map_id, top, bottom, left, right): the outermost strong lines in the margins, or where a sheet usually has them.

    lines: map_id, axis (``h``, ``v``), line; sizes: map_id, width, height."""
    rows = sizes.join(lines, "map_id", "left")
    line, w, h = F.col("line"), F.col("width"), F.col("height")
    hor = (F.col("axis") == "h") & (line > h * 0.03) & (line < h * 0.97)
    ver = (F.col("axis") == "v") & (line > w * 0.03) & (line < w * 0.97)
    return rows.groupBy("map_id", "width", "height").agg(
        F.min(F.when(hor & (line < h * 0.15), line)).alias("top"),
        F.max(F.when(hor & (line > h * 0.70) & (line < h * 0.92), line)).alias("bottom"),
        F.min(F.when(ver & (line < w * 0.15), line)).alias("left"),
        F.max(F.when(ver & (line > w * 0.85), line)).alias("right"),
    ).select(
        "map_id",
        F.coalesce("top", (h * 0.05).cast("int")).alias("top"),
        F.coalesce("bottom", (h * 0.85).cast("int")).alias("bottom"),
        F.coalesce("left", (w * 0.05).cast("int")).alias("left"),
        F.coalesce("right", (w * 0.95).cast("int")).alias("right"),
    )


def margin_strips(neatlines: DataFrame, outer: int = 180, inner: int = 500, below: int = 40) -> DataFrame:
    """(map_id, edge, x1, y1, x2, y2): the strips around the neatline in which labels stand.  neatlines have width, height."""
    t, b, lo, r, w, h = (F.col(c) for c in ("top", "bottom", "left", "right", "width", "height"))
    zero = F.lit(0)
    strips = [("top", lo, F.greatest(zero, t - outer), r, F.least(h, t + inner)), ("bottom", lo, F.greatest(zero, b - inner), r, F.least(h, b + below)), ("left", F.greatest(zero, lo - outer), t, F.least(w, lo + inner), b), ("right", F.greatest(zero, r - inner), t, F.least(w, r + outer), b)]
    boxes = F.array(*[F.struct(F.lit(e).alias("edge"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")) for e, x1, y1, x2, y2 in strips])
    return neatlines.select("map_id", F.inline(boxes))


def dedupe_readings(readings: DataFrame, distance: float = 50.0, keys: tuple[str, ...] = ("map_id", "edge")) -> DataFrame:
    """Readings (keys, id, pos, val, conf) of one place: in order of position, one nearer than ``distance`` to the last kept replaces it
    if its confidence is higher, else goes; the place moves with the replacement."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "val", "conf")))
    got = readings.groupBy(*keys).agg(rows.alias("_r"))

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        near = F.abs(r["pos"] - last["pos"]) < distance
        swap = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(r))
        return F.when(near, F.when(r["conf"] > last["conf"], swap).otherwise(acc)).otherwise(F.array_append(acc, r))

    kept = F.aggregate(F.slice("_r", F.lit(2), F.greatest(F.size("_r") - 1, F.lit(0))), F.slice("_r", 1, 1), step)
    return got.select(*keys, F.inline(kept)).select(*keys, "id", "pos", "val", "conf")


def decade_modes(labels: DataFrame, n: int = 2) -> DataFrame:
    """(map_id, axis, decade, count, rank): the commonest tens of a series; of equals the one that comes first."""
    got = labels.groupBy(*SERIES, F.floor(F.col("val") / 10).cast("long").alias("decade")).agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("_first"))
    w = Window.partitionBy(*SERIES).orderBy(F.desc("count"), "_first")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_first")
