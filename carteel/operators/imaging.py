"""Pixel operators: numpy in Arrow functions over tiles, everything around them in plain expressions.

Images are arrays of blue, green, red bytes.  A scan is cut into tiles with a
halo before anything is shuffled, and candidates go to the tile of their
position, so a task holds a tile, never a sheet.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import affine, buckets
from . import spatial

TILE, HALO = 1024, 64
TILES = "map_id string, tx int, ty int, x0 int, y0 int, height int, width int, channels int, data binary"


# arrays


def suppress_red(bgr: np.ndarray) -> np.ndarray:
    """Grey without red ink: the lesser of blue and green."""
    return np.minimum(bgr[..., 0], bgr[..., 1])


def suppress_colours(bgr: np.ndarray, boost: float = 0.5) -> np.ndarray:
    """Grey in which coloured ink fades: value plus a share of saturation."""
    v = bgr.max(axis=-1).astype(np.float32)
    s = np.rint(255.0 * (v - bgr.min(axis=-1)) / np.maximum(v, 1.0))
    return np.clip(v + boost * s, 0, 255).astype(np.uint8)


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luma by the usual weights, rounded."""
    return np.floor(bgr @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


def gaussian(img: np.ndarray, size: int) -> np.ndarray:
    """Gaussian mean over ``size`` pixels each way, borders repeated."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    out = np.pad(img.astype(np.float64), size // 2, mode="edge")
    out = sum(w * out[i : i + img.shape[0], :] for i, w in enumerate(k))
    return sum(w * out[:, i : i + img.shape[1]] for i, w in enumerate(k))


def black_white(img: np.ndarray, size: int = 25, less: float = 10.0) -> np.ndarray:
    """White where a pixel is lighter than its neighbourhood's mean less ``less``."""
    return np.where(img > np.rint(gaussian(img, size)) - less, 255, 0).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    """The threshold with the largest variance between the two classes."""
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mean = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below / total - mean) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binarised(bgr: np.ndarray, adaptive: bool = True) -> np.ndarray:
    """Dark ink as 255: red ink suppressed, then by neighbourhood or by Otsu's threshold."""
    img = suppress_red(bgr)
    return 255 - black_white(img) if adaptive else np.where(img > otsu(img), 0, 255).astype(np.uint8)


MODES = {
    "suppress_red": [suppress_red],
    "suppress_colors": [suppress_colours],
    "black_white": [lambda b: black_white(suppress_red(b))],
    "multi": [suppress_red, suppress_colours, lambda b: black_white(suppress_red(b))],
}


def correlation(img: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every place where the template fits; 0 where the image is flat."""
    if img.shape[0] < template.shape[0] or img.shape[1] < template.shape[1]:
        return np.zeros((0, 0))
    w = sliding_window_view(img.astype(np.float64), template.shape)
    t = template - template.mean()
    cross = np.einsum("ijkl,kl->ij", w, t)
    n = template.size
    spread = np.einsum("ijkl,ijkl->ij", w, w) - w.sum(axis=(2, 3)) ** 2 / n
    norm = np.sqrt(np.maximum(spread, 0) * (t * t).sum())
    return np.where(norm > 1e-6, cross / np.maximum(norm, 1e-6), 0.0)


def best_match(img: np.ndarray, templates: list[tuple[np.ndarray, float, float]]) -> tuple[float, float, float]:
    """(score, x, y): the best place of any template, at its centre plus its dot's offset."""
    best = (-1.0, 0.0, 0.0)
    for t, dx, dy in templates:
        c = correlation(img, t)
        if c.size:
            y, x = np.unravel_index(int(c.argmax()), c.shape)
            if c[y, x] > best[0]:
                best = (float(c[y, x]), x + t.shape[1] / 2 + dx, y + t.shape[0] / 2 + dy)
    return best


def gradient_edges(img: np.ndarray, least: float = 120.0) -> np.ndarray:
    """Edges as 255: Sobel magnitude from ``least`` on.  A plain substitute for hysteresis edges, whose exact thinning isn't reproduced."""
    p = np.pad(img.astype(np.float64), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.where(np.abs(gx) + np.abs(gy) >= least, 255, 0).astype(np.uint8)


def dot_centre(img: np.ndarray, x: float, y: float, radius: int = 6, most: float = 4.0) -> tuple[float, float, bool]:
    """The centroid of squared darkness around a match, two pixels lower, no farther than ``most`` from it."""
    cx, cy = int(np.rint(x)), int(np.rint(y))
    y1, y2 = max(0, cy - radius + 2), min(img.shape[0], cy + radius + 2)
    x1, x2 = max(0, cx - radius), min(img.shape[1], cx + radius)
    part = img[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)]
    dark = (255.0 - part.astype(np.float64)) ** 2
    if not part.size or not dark.sum():
        return x, y, False
    dx = (dark.sum(axis=0) @ np.arange(part.shape[1])) / dark.sum() + x1 - x
    dy = (dark.sum(axis=1) @ np.arange(part.shape[0])) / dark.sum() + y1 - y
    far = float(np.hypot(dx, dy))
    pull = min(1.0, most / far) if far else 1.0
    return x + dx * pull, y + dy * pull, True


def local_peaks(score: np.ndarray, least: float, distance: int) -> np.ndarray:
    """(x, y) of the cells that are the maximum of the square of ``distance`` around them, and at least ``least``."""
    if not score.size:
        return np.empty((0, 2), np.int64)
    p = np.pad(score, distance, constant_values=-np.inf)
    top = sliding_window_view(sliding_window_view(p, 2 * distance + 1, axis=0).max(axis=-1), 2 * distance + 1, axis=1).max(axis=-1)
    y, x = np.nonzero((score >= top) & (score >= least))
    return np.column_stack([x, y])


class Network:
    """Forward pass of the crop classifier: four blocks of 3x3 convolution, batch norm, ReLU and pooling
    (16, 32, 64, 64 channels), then 128 hidden units.  ``weights``: arrays by name; none are shipped."""

    CHANNELS = (16, 32, 64, 64)

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def random(cls, seed: int = 0) -> Network:
        draw, w, before = np.random.default_rng(seed), {}, 1
        for i, c in enumerate(cls.CHANNELS):
            w |= {f"conv{i}.w": draw.normal(0, (2 / (9 * before)) ** 0.5, (c, before, 3, 3)), f"conv{i}.b": np.zeros(c), f"bn{i}.scale": np.ones(c), f"bn{i}.shift": np.zeros(c), f"bn{i}.mean": np.zeros(c), f"bn{i}.var": np.ones(c)}
            before = c
        w |= {"fc0.w": draw.normal(0, 0.04, (128, 1024)), "fc0.b": np.zeros(128), "fc1.w": draw.normal(0, 0.1, (1, 128)), "fc1.b": np.zeros(1)}
        return cls(w)

    def parameters(self) -> int:
        """Trained numbers (the running means and variances aren't)."""
        return sum(v.size for k, v in self.w.items() if not k.endswith((".mean", ".var")))

    def __call__(self, crops: np.ndarray) -> np.ndarray:
        """Probabilities of crops (n, 64, 64), grey bytes."""
        x = crops[:, None].astype(np.float32) / 255.0
        for i in range(4):
            p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
            x = np.einsum("ncyxhw,ochw->noyx", sliding_window_view(p, (3, 3), axis=(2, 3)), self.w[f"conv{i}.w"], optimize=True)
            b = {k: self.w[f"bn{i}.{k}"][:, None, None] for k in ("scale", "shift", "mean", "var")}
            x = (x + self.w[f"conv{i}.b"][:, None, None] - b["mean"]) / np.sqrt(b["var"] + 1e-5) * b["scale"] + b["shift"]
            x = np.maximum(x, 0)
            n, c, h, w = x.shape
            x = x.reshape(n, c, h // 2, 2, w // 2, 2).max(axis=(3, 5))
        x = np.maximum(x.reshape(len(x), -1) @ self.w["fc0.w"].T + self.w["fc0.b"], 0)
        return 1.0 / (1.0 + np.exp(-(x @ self.w["fc1.w"].T + self.w["fc1.b"])[:, 0]))


def crop_features(img: np.ndarray) -> np.ndarray:
    """15 numbers of a whole grey crop for tree models: darkness, contrast, symmetry, profile and edge shares.  Not the reference's features (I31), which match templates."""
    g = img.astype(np.float64)
    dark = g < 128
    h, w = g.shape
    rows, cols = dark.mean(axis=1), dark.mean(axis=0)
    gy, gx = np.gradient(g)
    mag = np.hypot(gx, gy)
    mid = g[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4]
    total = max(dark.sum(), 1)
    ys, xs = np.nonzero(dark)
    return np.array([g.mean() / 255, g.std() / 255, dark.mean(), mid.mean() / 255, (mid < 128).mean(), np.abs(g - g[:, ::-1]).mean() / 255, np.abs(g - g[::-1]).mean() / 255, rows[: h // 2].mean(), rows[h // 2 :].mean(), cols.std(), rows.std(), mag.mean() / 255, (mag > 60).mean(), (ys.sum() / total) / h, (xs.sum() / total) / w])


def crop_sanity(img: np.ndarray) -> float:
    """Score of a grey crop: dark share by Otsu's threshold, contrast of the centre with the whole, left-right symmetry.

    0 for sides under 10 pixels and dark shares outside 3 to 50 %."""
    h, w = img.shape
    if h < 10 or w < 10:
        return 0.0
    dark = img <= otsu(img)
    share = dark.mean()
    if not 0.03 <= share <= 0.5:
        return 0.0
    cy, cx, r = h // 2, w // 2, max(2, min(h, w) // 6)
    contrast = (img.mean() - img[cy - r : cy + r, cx - r : cx + r].mean()) / max(img.mean(), 1)
    symmetry = 1.0 - (dark[:, : w // 2] != dark[:, (w + 1) // 2 :][:, ::-1]).mean()
    return float(0.3 * min(share / 0.15, 1.0) + 0.3 * max(0.0, contrast) + 0.4 * symmetry)


class TextReader(Protocol):
    """Recognises digits in a strip: (corner xs, corner ys, text, confidence) for each reading.  No implementation is shipped."""

    def __call__(self, strip: np.ndarray) -> list[tuple[list[float], list[float], str, float]]: ...


# DataFrames


def tiles(images: DataFrame, size: int = TILE, halo: int = HALO) -> DataFrame:
    """Images (map_id, height, width, channels, data) in tiles of ``size`` pixels with ``halo`` more on each side, cut where the rows are read."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                img = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                out = []
                for ty in range(-(-row.height // size)):
                    for tx in range(-(-row.width // size)):
                        y0, x0 = max(0, ty * size - halo), max(0, tx * size - halo)
                        part = img[y0 : (ty + 1) * size + halo, x0 : (tx + 1) * size + halo]
                        out.append((row.map_id, tx, ty, x0, y0, part.shape[0], part.shape[1], row.channels, part.tobytes()))
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in TILES.split(", ")])
                    out = []

    return images.select("map_id", "height", "width", "channels", "data").mapInPandas(run, TILES)


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def dark_profile(tile_rows: DataFrame, size: int = TILE, dark: int = 120, box: DataFrame | None = None) -> DataFrame:
    """(map_id, axis, pos, n): dark pixels of each row (axis h) and column (v), in ``box`` (map_id, top, bottom, left, right) if given.

    Each tile sums its own pixels, without the halo; the sums are added up by Spark."""
    rows = tile_rows.join(box, "map_id") if box is not None else tile_rows

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                img = grey(_pixels(row)) <= dark
                y1, x1, y2, x2 = row.ty * size, row.tx * size, (row.ty + 1) * size, (row.tx + 1) * size
                if box is not None:
                    y1, y2, x1, x2 = max(y1, row.top), min(y2, row.bottom), max(x1, row.left), min(x2, row.right)
                part = img[max(0, y1 - row.y0) : max(0, y2 - row.y0), max(0, x1 - row.x0) : max(0, x2 - row.x0)]
                out.append(pd.DataFrame({"map_id": row.map_id, "axis": "h", "pos": np.arange(part.shape[0]) + y1, "n": part.sum(axis=1)}))
                out.append(pd.DataFrame({"map_id": row.map_id, "axis": "v", "pos": np.arange(part.shape[1]) + x1, "n": part.sum(axis=0)}))
            yield from out

    return rows.mapInPandas(run, "map_id string, axis string, pos int, n long").groupBy("map_id", "axis", "pos").agg(F.sum("n").alias("n"))


def strong_lines(profile: DataFrame, sizes: DataFrame, share: float = 0.65) -> DataFrame:
    """(map_id, axis, pos) dark over more than ``share`` of the sheet: what ``labels.cluster_lines`` and ``labels.neatline`` start from."""
    span = F.when(F.col("axis") == "h", F.col("width")).otherwise(F.col("height"))
    return profile.join(sizes, "map_id").filter(F.col("n") > span * share).select("map_id", "axis", "pos")


def verify_candidates(points: DataFrame, transforms: DataFrame, sizes: DataFrame, tile_rows: DataFrame, templates: list[tuple[np.ndarray, float, float]], mode: str = "multi", half: int = 40, size: int = TILE) -> DataFrame:
    """(map_id, pid, px, py, confidence, method): how well the symbol's templates match at each projected point.

    points: map_id, pid, x, y.  Points whose window leaves the image are left
    out.  The best preprocessing of ``mode`` counts; from 0.45 on the place is moved to the dot."""
    px, py = affine.map_to_pixel(F.col("x"), F.col("y"))
    at = points.join(transforms.select("map_id", *affine.NAMES), "map_id").join(sizes.select("map_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "map_id")
    at = at.select("map_id", "pid", "_w", "_h", px.alias("px"), py.alias("py")).filter(spatial.in_frame(F.col("px"), F.col("py"), F.lit(half), F.col("_w"), F.col("_h")))
    at = at.withColumn("tx", F.floor(F.rint("px") / size).cast("int")).withColumn("ty", F.floor(F.rint("py") / size).cast("int")).groupBy("map_id", "tx", "ty").agg(F.collect_list(F.struct("pid", "px", "py")).alias("points"))

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                img = _pixels(row)
                views = [f(img) for f in MODES[mode]]
                edges = [gradient_edges(v) for v in views]
                sharp = [(gradient_edges(t), dx, dy) for t, dx, dy in templates]
                for p in row.points:
                    cx, cy = int(np.rint(p["px"])) - row.x0, int(np.rint(p["py"])) - row.y0
                    best = None
                    for view, edge in zip(views, edges, strict=True):
                        cut = (slice(cy - half, cy + half), slice(cx - half, cx + half))
                        g, e = best_match(view[cut], templates), best_match(edge[cut], sharp)
                        score = max(g[0], e[0]) * (1.05 if g[0] >= 0.45 and e[0] >= 0.25 else 1.0)
                        if best is None or score > best[0]:
                            place = g if g[0] >= e[0] else e
                            if score >= 0.45:
                                place = (place[0], *dot_centre(view[cut], place[1], place[2])[:2])
                            best = (score, g[0], e[0], place[1] - half, place[2] - half)
                    out.append((row.map_id, p["pid"], cx + row.x0 + best[3], cy + row.y0 + best[4], best[1], best[2]))
            yield pd.DataFrame(out, columns=["map_id", "pid", "px", "py", "gray", "edge"])

    scored = at.join(tile_rows, ["map_id", "tx", "ty"]).mapInPandas(run, "map_id string, pid long, px double, py double, gray double, edge double")
    fused = buckets.fused_score(F.col("gray"), F.col("edge"))
    return scored.select("map_id", "pid", "px", "py", fused["score"].alias("confidence"), fused["method"].alias("method"))


def template_candidates(tile_rows: DataFrame, templates: list[tuple[np.ndarray, float, float]], least: float = 0.5, distance: int = 10, size: int = TILE) -> DataFrame:
    """(map_id, px, py, score): local maxima of each template's match over whole sheets; thin them with ``spatial.suppress``.  Peaks in a halo belong to the neighbour."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                img, out = suppress_red(_pixels(row)), []
                for t, dx, dy in templates:
                    score = correlation(img, t)
                    for x, y in local_peaks(score, least, distance):
                        px, py = row.x0 + x + t.shape[1] / 2 + dx, row.y0 + y + t.shape[0] / 2 + dy
                        if row.tx * size <= px < (row.tx + 1) * size and row.ty * size <= py < (row.ty + 1) * size:
                            out.append((row.map_id, px, py, float(score[y, x])))
                yield pd.DataFrame(out, columns=["map_id", "px", "py", "score"])

    return tile_rows.mapInPandas(run, "map_id string, px double, py double, score double")


def classify_crops(crops: DataFrame, network: Network, batch: int = 2048) -> DataFrame:
    """Adds ``prob`` to crops with ``data``: 64x64 grey bytes."""
    shared = crops.sparkSession.sparkContext.broadcast(network.w)  # a model of fixed size

    @F.pandas_udf("double")
    def prob(parts: pd.Series) -> pd.Series:
        net = Network(shared.value)
        out = [net(np.stack([np.frombuffer(d, np.uint8).reshape(64, 64) for d in parts[i : i + batch]])) for i in range(0, len(parts), batch)]
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return crops.withColumn("prob", prob("data"))


def featured_crops(crops: DataFrame) -> DataFrame:
    """Adds ``features``, 15 numbers, to crops with ``data``, for pyspark.ml classifiers."""

    @F.pandas_udf("array<double>")
    def features(parts: pd.Series) -> pd.Series:
        return parts.map(lambda d: crop_features(np.frombuffer(d, np.uint8).reshape(64, 64)).tolist())

    return crops.withColumn("features", features("data"))
