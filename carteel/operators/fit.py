"""Least-squares and robust transforms from pixels to world coordinates.

Observations are (map_id, px, py, x, y) with further columns; a transform is a
row (map_id, a..f, n, rmse_component_m, rmse_radial_m).  The two errors differ by
the square root of two: the mean is over both coordinates or over points.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine


MOMENTS = {"n": "count(px)", "_mx": "avg(px)", "_my": "avg(py)", "_mu": "avg(x)", "_mv": "avg(y)", "_sxx": "var_pop(px)", "_syy": "var_pop(py)", "_sxy": "covar_pop(px, py)", "_suu": "var_pop(x)", "_svv": "var_pop(y)", "_ux": "covar_pop(px, x)", "_uy": "covar_pop(py, x)", "_vx": "covar_pop(px, y)", "_vy": "covar_pop(py, y)"}


def _solved(moments: DataFrame) -> DataFrame:
    """Adds the six coefficients to centred moments, null for fewer than three points or collinear ones."""
    sxx, syy, sxy = (F.col(c) for c in ("_sxx", "_syy", "_sxy"))
    det = sxx * syy - sxy * sxy
    sound = moments.withColumn("_det", F.when((F.col("n") >= 3) & (det > F.lit(1e-12) * sxx * syy) & (det > 0), det))
    mx, my, det = F.col("_mx"), F.col("_my"), F.col("_det")
    out: dict[str, Column] = {}
    for u, v, along, across in (("_ux", "_uy", "a", "c"), ("_vx", "_vy", "b", "d")):
        out[along] = (F.col(u) * syy - F.col(v) * sxy) / det
        out[across] = (F.col(v) * sxx - F.col(u) * sxy) / det
    found = sound.withColumns(out)
    return found.withColumns({"e": F.col("_mu") - F.col("a") * mx - F.col("c") * my, "f": F.col("_mv") - F.col("b") * mx - F.col("d") * my})


def residual(t: dict[str, Column] | None = None) -> tuple[Column, Column]:
    x, y = affine.pixel_to_map(F.col("px"), F.col("py"), t)
    return F.col("x") - x, F.col("y") - y


def _fits(rows: DataFrame, key: str) -> DataFrame:
    """A transform for each map from one aggregation, with ``_spread``: its radial RMSE from the same moments, good to about 1e-5 m."""
    found = _solved(rows.groupBy(key).agg(*[F.expr(m).alias(c) for c, m in MOMENTS.items()])).filter("a IS NOT NULL")
    left = F.col("_suu") + F.col("_svv") - F.col("a") * F.col("_ux") - F.col("c") * F.col("_uy") - F.col("b") * F.col("_vx") - F.col("d") * F.col("_vy")
    return found.select(key, *affine.NAMES, "n", F.sqrt(F.greatest(left, F.lit(0.0))).alias("_spread"))


def fit_affine(rows: DataFrame, key: str = "map_id") -> DataFrame:
    """One transform for each map, with both errors; maps without a sound fit have none."""
    return with_errors(rows, _fits(rows, key).drop("_spread"), key)


def with_errors(rows: DataFrame, fits: DataFrame, key: str = "map_id") -> DataFrame:
    """Adds rmse_component_m, rmse_radial_m and max_error_m of the rows to their transforms; maps without rows go."""
    dx, dy = residual()
    square = dx * dx + dy * dy
    graded = rows.select(key, "px", "py", "x", "y").join(fits, key).withColumn("_square", square)
    return graded.groupBy(*fits.columns).agg(F.sqrt(F.avg("_square") / 2).alias("rmse_component_m"), F.sqrt(F.avg("_square")).alias("rmse_radial_m"), F.sqrt(F.max("_square")).alias("max_error_m"))


def residuals(rows: DataFrame, fits: DataFrame, key: str = "map_id") -> DataFrame:
    """The rows with dx, dy and error in metres."""
    dx, dy = residual()
    return rows.join(fits.select(key, *affine.NAMES), key).withColumns({"dx": dx, "dy": dy, "error": F.hypot(dx, dy)}).drop(*affine.NAMES)


def trim_and_refit(rows: DataFrame, threshold: float = 15.0, factor: float = 2.0, rmse: str = "rmse_radial_m", key: str = "map_id") -> DataFrame:
    """Fit; drop rows with an error of max(threshold, factor * rmse) or more; fit the rest once more, if at least three and fewer than all.

    The result has n (rows of the map), n_inliers, and the errors of the final fit over the inliers.  ``rmse``: which error sets the threshold."""
    limit = F.greatest(F.lit(float(threshold)), F.col("_spread") * (factor if rmse == "rmse_radial_m" else factor / 2**0.5))
    first = _fits(rows, key).select(key, F.struct(*affine.NAMES).alias("_t"), F.col("n").alias("_all"), limit.alias("_limit"))
    slim = rows.select(key, "px", "py", "x", "y")
    dx, dy = residual({c: F.col(f"_t.{c}") for c in affine.NAMES})
    inside = F.hypot(dx, dy) < F.col("_limit")
    kept = slim.join(first, key).withColumn("_in", inside).select(key, "_t", "_all", "_limit", "_in", *[F.when(F.col("_in"), F.col(c)).alias(c) for c in ("px", "py", "x", "y")])
    again = (F.col("n") >= 3) & (F.col("n") < F.col("_all"))
    both = kept.groupBy(key, "_t", "_all", "_limit").agg(*[F.expr(m).alias(c) for c, m in MOMENTS.items()])
    # three or more inliers on a line have no fit of their own: such a map is left out
    solved = _solved(both).withColumn("_again", again).filter("NOT _again OR a IS NOT NULL")
    held = F.when(F.col("n") < 3, F.col("_all")).otherwise(F.col("n"))
    final = solved.select(key, *[F.when(F.col("_again"), F.col(c)).otherwise(F.col(f"_t.{c}")).alias(c) for c in affine.NAMES], F.col("_all").alias("n"), held.alias("n_inliers"), "_t", "_limit", "_again")
    used = slim.join(final, key).filter(~F.col("_again") | inside)
    x, y = residual()
    square = x * x + y * y
    errors = [F.sqrt(F.avg("_square") / 2).alias("rmse_component_m"), F.sqrt(F.avg("_square")).alias("rmse_radial_m"), F.sqrt(F.max("_square")).alias("max_error_m")]
    return used.withColumn("_square", square).groupBy(key, *affine.NAMES, "n", "n_inliers").agg(*errors)


def fit_polynomial(rows: DataFrame, key: str = "map_id") -> DataFrame:
    """Order 2 by least squares, for maps with at least six points: cx, cy (for 1, x, y, xy, x^2, y^2), n, rmse_component_m."""
    import pyarrow as pa

    kind = dict(rows.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        px, py, x, y = (table[c].to_numpy().astype(float) for c in ("px", "py", "x", "y"))
        ok = len(px) >= 6
        cx = cy = np.empty(0)
        rmse = 0.0
        if ok:
            design = np.column_stack([np.ones(len(px)), px, py, px * py, px**2, py**2])
            scale = np.abs(design).max(axis=0)
            scale[scale == 0] = 1.0
            sol = np.linalg.lstsq(design / scale, np.column_stack([x, y]), rcond=None)[0] / scale[:, None]
            off = np.column_stack([x, y]) - design @ sol
            cx, cy, rmse = sol[:, 0], sol[:, 1], float(np.sqrt((off**2).mean()))
        n = 1 if ok else 0
        return pa.table({key: table[key].slice(0, n), "cx": pa.array([cx.tolist()] * n, pa.list_(pa.float64())), "cy": pa.array([cy.tolist()] * n, pa.list_(pa.float64())), "n": pa.array([len(px)] * n, pa.int64()), "rmse_component_m": pa.array([rmse] * n, pa.float64())})

    return rows.groupBy(key).applyInArrow(run, f"`{key}` {kind}, cx array<double>, cy array<double>, n long, rmse_component_m double")


def triples(rows: DataFrame, key: str = "map_id") -> DataFrame:
    """All triples (i < j < k) of a map's rows (``id`` from 1) with the transform through them; none for collinear ones.  n*(n-1)*(n-2)/6 rows: thin first."""

    def named(i: str) -> DataFrame:
        return rows.select(key, *[F.col(c).alias(f"{c}_{i}") for c in ("id", "px", "py", "x", "y")])

    t = named("i").join(named("j"), key).filter("id_i < id_j").join(named("k"), key).filter("id_j < id_k")
    ux, uy = F.col("px_j") - F.col("px_i"), F.col("py_j") - F.col("py_i")
    vx, vy = F.col("px_k") - F.col("px_i"), F.col("py_k") - F.col("py_i")
    det = ux * vy - vx * uy
    out = {}
    for c, (along, across, offset) in (("x", ("a", "c", "e")), ("y", ("b", "d", "f"))):
        du, dv = F.col(f"{c}_j") - F.col(f"{c}_i"), F.col(f"{c}_k") - F.col(f"{c}_i")
        out[along], out[across] = F.try_divide(du * vy - dv * uy, det), F.try_divide(dv * ux - du * vx, det)
        out[offset] = F.col(f"{c}_i") - out[along] * F.col("px_i") - out[across] * F.col("py_i")
    return t.select(key, "id_i", "id_j", "id_k", *[out[n].alias(n) for n in affine.NAMES]).filter("a IS NOT NULL")


def consensus_affine(rows: DataFrame, threshold: float = 15.0, least: int = 5, key: str = "map_id") -> DataFrame:
    """The rows (id, px, py, x, y) on the transform through three of them that most rows agree with to less than ``threshold``, by trying all
    triples (the first of equals), if at least ``least``.  Fit them for the transform."""
    tried = triples(rows, key)
    dx, dy = residual()
    near = F.hypot(dx, dy) < threshold
    votes = tried.join(rows.select(key, "px", "py", "x", "y"), key).groupBy(key, "id_i", "id_j", "id_k", *affine.NAMES).agg(F.count(F.when(near, 1)).alias("_n")).filter(F.col("_n") >= least)
    best = votes.groupBy(key).agg(F.min_by(F.struct(*affine.NAMES), F.struct(-F.col("_n"), "id_i", "id_j", "id_k")).alias("_t")).select(key, "_t.*")
    return rows.join(best, key).filter(near).drop(*affine.NAMES)


def sampled_consensus(rows: DataFrame, tries: int = 500, threshold: float = 15.0, least: int = 5, seed: int = 0, key: str = "map_id") -> DataFrame:
    """As ``consensus_affine`` for larger maps: at most ``tries`` triples, the same on each run; all of them where there are no more."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        p = np.column_stack([table["px"].to_numpy(), table["py"].to_numpy(), np.ones(len(table))]).astype(float)
        w = np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()]).astype(float)
        n, best = len(p), np.zeros(len(p), bool)
        if n >= 3:
            few = n * (n - 1) * (n - 2) // 6 <= tries
            draw = np.random.default_rng(seed)
            picks = combinations(range(n), 3) if few else (draw.choice(n, 3, replace=False) for _ in range(tries))
            for pick in picks:
                i = list(pick)
                if abs(np.linalg.det(p[i])) < 1e-9:
                    continue
                near = np.hypot(*(w - p @ np.linalg.solve(p[i], w[i])).T) < threshold
                if near.sum() > best.sum():
                    best = near
        return table.filter(pa.array(best if best.sum() >= least else np.zeros(n, bool)))

    return rows.groupBy(key).applyInArrow(run, rows.schema)
