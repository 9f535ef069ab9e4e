"""Classes for confidences, errors and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def graded(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step that ``value`` reaches."""
    out = None
    for least, name in steps:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(rest)


def confidence_class(confidence: Column, high: float = 0.7, mid: float = 0.5) -> Column:
    """Pairs in use: 0.7/0.5 for matches, 0.9/0.7 and 0.85/0.7 for model scores."""
    return graded(confidence, [(high, "high"), (mid, "medium")], "low")


def error_status(median_error: Column) -> Column:
    return F.when(median_error <= 7, "automatic").when(median_error <= 15, "refine").otherwise("excessive")


def error_colour(error: Column) -> Column:
    return F.when(error < 25, "green").when(error < 70, "amber").otherwise("red")


def fused_score(gray: Column, edge: Column) -> Column:
    """(score, method) of two matchers: the better one, or, where both hold, 1.05 times it; may pass 1."""
    best = F.greatest(gray, edge)
    both = (gray >= 0.45) & (edge >= 0.25)
    return F.struct(F.when(both, best * 1.05).otherwise(best).alias("score"), F.when(both, "combined").when(gray >= edge, "grayscale").otherwise("edge").alias("method"))


def gated(confidence: Column, method: Column, probability: Column, least: float = 0.5) -> Column:
    """(confidence, method) after a classifier: a rejected candidate keeps a tenth of its probability; null probability (out of frame) means no gate."""
    no = F.coalesce(probability < least, F.lit(False))
    return F.struct(F.when(no, probability * 0.1).otherwise(confidence).alias("confidence"), F.when(no, "cnn_rejected").otherwise(method).alias("method"))


def readiness(image: Column, world: Column, gcps: Column, points: Column, ingested: Column) -> Column:
    """What a map waits for, or that it is ready: by its image, world file, number of GCPs (null without), number of points (null without), and whether its crops are in already."""
    targets = F.coalesce(points, gcps, F.lit(0))
    return (
        F.when(image.isNull(), "waiting for image")
        .when(world.isNull() & gcps.isNull(), "waiting for transform")
        .when(targets == 0, "waiting for control points")
        .when(ingested, "already ingested")
        .otherwise("ready")
    )
