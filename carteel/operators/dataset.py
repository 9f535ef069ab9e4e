"""Management of labelled crops: label routing, splits without leakage, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_held_out(crops: DataFrame, held_out: DataFrame, name: str = "file_name") -> DataFrame:
    """Crops of no held-out map.  held_out: map_id, a short list, a part of the code base rather than of the data."""
    return crops.withColumn("_m", F.regexp_extract(name, r"^(.*?)_", 1)).join(F.broadcast(held_out.select(F.col("map_id").alias("_m"))), "_m", "left_anti").drop("_m")


#: Where a label sends a crop of a folder: (folder, label) -> (action, goal).
ROUTES = {
    ("positive", "neg"): ("move", "negative"),
    ("positive", "partial"): ("move", "partial"),
    ("hard_negative", "pos"): ("copy", "positive"),
    ("hard_negative", "partial"): ("copy", "partial"),
    ("qa", "pos"): ("copy", "positive"),
    ("qa", "neg"): ("copy", "hard_negative"),
    ("qa", "partial"): ("copy", "partial"),
}


def label_actions(labels: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_name, folder, label, action, goal, skipped) for labels of crops that are there.

    labels: folder, file_name, label; listing: folder, file_name.  A label for a
    name that isn't there counts for the first file of the folder with its stem, in ``qa`` only.
    ``skip`` and unknown labels do nothing; ``skipped`` tells that the goal has a file of that name."""
    files = listing.select("folder", "file_name").distinct()
    stems = files.filter("folder = 'qa'").groupBy("folder", F.regexp_replace("file_name", r"\.[^.]*$", "").alias("_stem")).agg(F.min("file_name").alias("_by_stem"))
    exact = files.withColumn("_exact", F.col("file_name"))
    found = labels.join(exact, ["folder", "file_name"], "left").withColumn("_stem", F.regexp_replace("file_name", r"\.[^.]*$", "")).join(stems, ["folder", "_stem"], "left")
    found = found.withColumn("file_name", F.coalesce("_exact", "_by_stem")).filter("file_name IS NOT NULL")
    routes = F.create_map(*[x for (f, n), (a, g) in ROUTES.items() for x in (F.lit(f"{f}/{n}"), F.struct(F.lit(a).alias("action"), F.lit(g).alias("goal")))])
    found = found.withColumn("_r", F.try_element_at(routes, F.concat_ws("/", "folder", "label"))).filter("_r IS NOT NULL")
    there = files.select(F.col("folder").alias("_goal"), F.col("file_name").alias("_name"), F.lit(True).alias("_there"))
    out = found.join(there, (F.col("_r.goal") == F.col("_goal")) & (F.col("file_name") == F.col("_name")), "left")
    return out.select("file_name", "folder", "label", F.col("_r.action").alias("action"), F.col("_r.goal").alias("goal"), F.coalesce("_there", F.lit(False)).alias("skipped"))


def reject_actions(rejects: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_name, folder, goal): a rejected crop moves to ``negative`` from ``positive``, else from ``partial``.  rejects: file_name."""
    files = listing.filter("folder IN ('positive', 'partial')").groupBy("file_name").agg(F.max("folder").alias("folder"))
    return rejects.select("file_name").distinct().join(files, "file_name").withColumn("goal", F.lit("negative"))


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("folder", "label", "action", "goal").agg(F.count(F.lit(1)).alias("n"), F.count_if("skipped").alias("n_skipped"))


def label_counts(labels: DataFrame, listing: DataFrame) -> DataFrame:
    """For each folder: pos, neg, partial, skip, and how many crops have no label yet."""
    rows = listing.join(labels, ["folder", "file_name"], "left")
    return rows.groupBy("folder").agg(*[F.count_if(F.col("label") == v).alias(v) for v in ("pos", "neg", "partial", "skip")], F.count_if(F.col("label").isNull()).alias("remaining"))


def without_rescued(negatives: DataFrame, hard: DataFrame, positives: DataFrame, partials: DataFrame) -> DataFrame:
    """Negatives and hard negatives (file_name) that aren't positive or partial by now; of a name in both, the negative."""
    good = positives.select("file_name").unionByName(partials.select("file_name")).distinct()
    plain = negatives.join(good, "file_name", "left_anti").withColumn("folder", F.lit("negative"))
    extra = hard.join(good, "file_name", "left_anti").join(negatives.select("file_name"), "file_name", "left_anti").withColumn("folder", F.lit("hard_negative"))
    return plain.unionByName(extra)


#: Ranges of the order in which the rows of a class are ranked, each by itself.
RANGES = 1024


def split(crops: DataFrame, order: list[Column] | None = None, share: float = 0.8, by: str = "label", seed: int = 42, first: str = "train", rest: str = "val") -> DataFrame:
    """Adds ``split``: of each class the first floor(share * n) rows in order go to ``first``.

    Without ``order`` a hash of the name decides, so a crop keeps its place
    from run to run as far as the number of crops allows.  ``order`` begins with a
    number; its quantiles (RANGES numbers on the driver) cut the classes into
    ranges.  A rank is the rows in all ranges before and the place in its own, so
    no task holds a class."""
    if order is None:
        mixed = F.xxhash64(F.col("file_name"), F.lit(seed))
        order, place = [mixed, F.col("file_name")], F.shiftrightunsigned(mixed.bitwiseXOR(F.lit(-(2**63))), 64 - 10).cast("int")
    else:
        cuts = crops.agg(F.percentile_approx(order[0], [k / RANGES for k in range(1, RANGES)])).first()[0] or []
        cuts = F.array(*map(F.lit, dict.fromkeys(cuts))) if cuts else F.array().cast("array<long>")
        place = F.size(F.filter(cuts, lambda q: q < order[0]))
    rows = crops.withColumns({"_place": place, "_class": F.col(by)})
    ends = rows.groupBy("_class", "_place").agg(F.count(F.lit(1)).alias("_here"))
    upto = Window.partitionBy("_class").orderBy("_place")  # RANGES rows a class
    ends = ends.withColumns({"_before": F.sum("_here").over(upto) - F.col("_here"), "_n": F.sum("_here").over(Window.partitionBy("_class"))})
    ends = ends.select(F.col("_class").alias("_c"), F.col("_place").alias("_p"), "_before", "_n")
    ranked = rows.join(ends, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_place") == F.col("_p")))
    k = F.col("_before") + F.row_number().over(Window.partitionBy("_class", "_place").orderBy(*order))
    return ranked.withColumn("split", F.when(k <= F.floor(F.col("_n") * share), first).otherwise(rest)).select(*[F.col(f"`{c}`") for c in crops.columns], "split")


def split_val_first(crops: DataFrame, share: float = 0.2, **how) -> DataFrame:
    """As ``split``, with the first floor(share * n) rows for validation."""
    return split(crops, share=share, first="val", rest="train", **how)


def class_weights(crops: DataFrame, by: str = "label") -> DataFrame:
    """Adds ``weight``: one over the number of rows of the class."""
    counts = crops.groupBy(F.col(by).alias("_class")).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return crops.join(counts, F.col(by).eqNullSafe(F.col("_class"))).drop("_class")


def training_sample(crops: DataFrame, ratio: float = 0.0, partials: bool = True, seed: int = 42) -> DataFrame:
    """(file_name, label): positives, partials as positives, and negatives, at most ``ratio`` of them for each positive (0: all),
    those with ``hn`` in their name first, then by a hash of the name.  crops: folder, file_name."""
    good = crops.filter(F.col("folder").isin("positive", *(["partial"] if partials else []))).select("file_name", F.lit(1).alias("label"))
    bad = crops.filter(F.col("folder").isin("negative", "hard_negative")).select("file_name", F.lit(0).alias("label"))
    if ratio:
        # places among the negatives and the number of positives are both part of the plan: nothing runs while it is built
        order = F.struct((~F.col("file_name").contains("hn")).alias("late"), F.xxhash64("file_name", F.lit(seed)).alias("mixed"), "file_name")
        most = good.agg(F.floor(F.count(F.lit(1)) * ratio).cast("long").alias("_most")).scalar()
        ranked = bad.withColumns({"_order": order, "_range": F.when(F.col("file_name").contains("hn"), 0).otherwise(RANGES) + F.shiftrightunsigned(F.xxhash64("file_name", F.lit(seed)).bitwiseXOR(F.lit(-(2**63))), 64 - 10).cast("int")})
        ends = ranked.groupBy("_range").agg(F.count(F.lit(1)).alias("_here")).withColumn("_before", F.sum("_here").over(Window.orderBy("_range")) - F.col("_here")).drop("_here")  # 2 * RANGES rows
        k = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_order"))
        bad = ranked.join(F.broadcast(ends), "_range").withColumn("_k", k).filter(F.col("_k") <= most).select("file_name", "label")
    return good.unionByName(bad)


def gather_held_out(listing: DataFrame, map_id: str) -> DataFrame:
    """(file_name, label) of a held-out map: positive and partial are 1, negatives 0; names with ``_dbh`` don't count; a name counts once."""
    rank = F.create_map(*[x for i, f in enumerate(("positive", "partial", "negative", "hard_negative")) for x in (F.lit(f), F.lit(i))])
    rows = listing.filter(F.col("file_name").startswith(map_id + "_") & ~F.col("file_name").contains("_dbh")).withColumn("_r", F.try_element_at(rank, F.col("folder"))).filter("_r IS NOT NULL")
    first = Window.partitionBy("file_name", F.col("_r") < 2).orderBy("_r")
    return rows.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("file_name", (F.col("_r") < 2).cast("int").alias("label"))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def review_order(crops: DataFrame, by: str = "confidence") -> DataFrame:
    """Crops for review: the least confident first, by name, or by map and then confidence."""
    keys = {"confidence": ["confidence", "file_name"], "name": ["file_name"], "map": ["map_id", "confidence", "file_name"]}[by]
    return crops.orderBy(*keys)
