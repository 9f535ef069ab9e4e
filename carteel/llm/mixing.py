"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

A hash puts each source's documents in a random order and cuts it into at most
``BLOCKS`` blocks, or ``SHARE`` times the number of shards, if that is more.  A source's target is some whole passes over its blocks and a
part of one more, which gives an exact number of block copies, its quota.  A
binary tree splits the quotas among output shards: each inner node draws, source
by source, how many of its block copies go left, by the hypergeometric
distribution of a draw without replacement, so that every shard gets as many
block copies as any other, up to one.  Each shard then takes its own range of each
source's permuted block copies, and a hash orders the documents inside a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import whole_row, workspace, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Blocks of a source at least offered, and for each shard; powers of two.
BLOCKS, SHARE = 4096, 16
#: Shards at least, a power of two, and words of a shard at most (about 200 MB of text), so that a task can hold one at any size of the mix.
SHARDS, SHARD_WORDS = 16, 1 << 25
WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    """Sources as text that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def _numbered() -> list[Column]:
    """_id, doc_id, _key, size, _text: a number for each row, which stays once it is written, and a hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return [F.monotonically_increasing_id().alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("source")).alias("_key"), words.alias("size"), F.xxhash64(text).alias("_text")]


def shards_for(words: int, shards: int = SHARDS, most: int = SHARD_WORDS) -> int:
    """The least power of two from ``shards`` on that leaves at most ``most`` words to a shard."""
    while shards * most < words:
        shards *= 2
    return shards


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_key, source_size, target) from (_key, source_size): a row for each source.

    The weights repeat over the sources in order.  The sources share the sum of
    all sizes by weight, but none gets more than ``cap`` times its own size.
    With sources in order of cap per weight, those that stop are the first ones."""
    by_name, by_fill = Window.orderBy("_key"), Window.orderBy("_fill", "_key")  # a row for each source
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    rows = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), number.cast("int"))).withColumn("_cap", (F.lit(cap) * F.col("source_size")).cast("double"))
    rows = rows.withColumn("_fill", F.col("_cap") / F.col("_weight"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_all": F.sum("source_size").over(everything).cast("double"), "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_open": F.sum("_weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_open"))
    stops = F.col("_fill") <= F.col("_level")
    rows = rows.withColumn("_number", F.row_number().over(by_fill)).withColumn("_first", F.min(F.when(~stops, F.col("_number"))).over(everything))
    shared = F.max(F.when(F.col("_number") == F.col("_first"), F.col("_level"))).over(everything)
    return rows.withColumn("_shared", shared).select("_key", "source_size", F.when(stops, F.col("_cap")).otherwise(F.col("_weight") * F.col("_shared")).alias("target"))


def _log_factorial(n: Column) -> Column:
    """Exact to rounding: Stirling's series from 21 on."""
    x = F.greatest(n, F.lit(21)).cast("double")
    series = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + F.lit(1.0) / (x * 12) - F.lit(1.0) / (x * x * x * 360) + F.lit(1.0) / (x * x * x * x * x * 1260)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(u: Column, good: Column, bad: Column, drawn: Column) -> Column:
    """How many of ``drawn`` out of ``good + bad`` are good: the quantile of ``u`` in [0, 1).

    Weights are summed over the values within 9 standard deviations of the mode."""
    total = good + bad
    low, high = F.greatest(F.lit(0).cast("long"), drawn - bad), F.least(good, drawn)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1).cast("double") * (good + 1) / (total + 2)).cast("long")))
    g, b, d, t = (c.cast("double") for c in (good, bad, drawn, total))
    spread = F.sqrt(F.greatest(F.lit(0.0), d * g * b * (t - d) / F.greatest(F.lit(1.0), t * t * (t - 1))))
    reach = (F.ceil(spread * 9) + 9).cast("long")

    def weight(x: Column, top: Column) -> Column:
        parts = [(good, x), (bad, drawn - x)]
        logs = [_log_factorial(k) + _log_factorial(n - k) for n, k in parts]
        most = [_log_factorial(k) + _log_factorial(n - k) for n, k in [(good, top), (bad, drawn - top)]]
        return F.exp(most[0] + most[1] - logs[0] - logs[1])

    def quantile(s: Column) -> Column:
        values = F.transform(F.sequence(F.greatest(low, s["mode"] - s["reach"]), F.least(high, s["mode"] + s["reach"])), lambda x: F.struct(x.alias("x"), weight(x, s["mode"]).alias("w")))

        def pick(v: Column) -> Column:
            goal = F.aggregate(v, F.lit(0.0), lambda a, e: a + e["w"]) * u
            start = F.struct(F.lit(0.0).alias("sum"), F.element_at(v, 1)["x"].alias("x"))
            return F.aggregate(v, start, lambda a, e: F.when(a["sum"] <= goal, F.struct((a["sum"] + e["w"]).alias("sum"), e["x"].alias("x"))).otherwise(a))["x"]

        return _let(values, pick)

    return _let(F.struct(mode.alias("mode"), reach.alias("reach")), quantile)


def _to_left(seed: int, level: int):
    """A step over the sources of a node: how many block copies of each go left, given what the ones before took."""

    def step(a: Column, e: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), e["key"]), 11).cast("double") / F.lit(float(2**53))
        x = hypergeometric(u, e["n"], a["rest"] - e["n"], a["left"])
        return _let(x, lambda v: F.struct((a["rest"] - e["n"]).alias("rest"), (a["left"] - v).alias("left"), F.array_append(a["x"], v).alias("x")))

    return step


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(_key, shard, quota) from (_key, quota): a row for each source and shard with a quota over 0.

    ``shards`` is a power of two.  A node's row holds a number for each source that it has block copies of."""
    tree = quotas.filter("quota > 0").agg(F.array_sort(F.collect_list(F.struct(F.col("_key").alias("key"), F.col("quota").cast("long").alias("n")))).alias("q")).select(F.lit(0).alias("node"), "q")
    for level in range(int(math.log2(shards))):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, e: a + e["n"])
        tree = tree.select("node", "q", total.alias("total"))
        start = F.struct(F.col("total").alias("rest"), F.ceil(F.col("total") / 2).cast("long").alias("left"), F.expr("cast(array() as array<bigint>)").alias("x"))
        tree = tree.select("node", "q", F.aggregate("q", start, _to_left(seed, level))["x"].alias("x"))
        left = F.zip_with("q", "x", lambda e, x: F.struct(e["key"].alias("key"), x.alias("n")))
        right = F.zip_with("q", "x", lambda e, x: F.struct(e["key"].alias("key"), (e["n"] - x).alias("n")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))
        # a source without block copies in a node isn't carried on: a level never has more entries than there are block copies
        tree = tree.select(F.explode(halves).alias("h")).select("h.node", F.filter("h.q", lambda e: e["n"] > 0).alias("q"))
    return tree.select(F.col("node").alias("shard"), F.explode("q").alias("e")).select(F.col("e.key").alias("_key"), "shard", F.col("e.n").alias("quota")).filter("quota > 0")


def _partial(placed: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The part of a pass: (_key, _spans) and (_key, _over), from rows (_key, _block, size, _end, _rest).

    Each source is filled in order; a document that doesn't fit what is left is
    skipped, and filling goes on over all the rest of the source.  A round takes
    what comes before the next such document by prefix sums over blocks, then
    inside the block where they pass what is left, and keeps only the rows
    behind it that still fit, until a source has none.  A span (from, to, left)
    stands for the rows that end in (from, to] and have at most ``left`` words.
    ``_over`` is the end of one more document that overshoots, if that comes
    nearer to the target.  A row with words is alone at its end of the source."""
    some = placed.filter((F.col("size") > 0) & (F.col("_rest") > 0)).select("_key", "_block", "size", "_end", "_rest")
    state = some.groupBy("_key").agg(F.max("_rest").alias("_rest"), F.coalesce(F.max(F.when(F.col("_end") <= F.col("_rest"), F.col("_end"))), F.lit(0)).alias("_to"))
    first = F.struct(F.lit(0).cast("long").alias("from"), F.col("_to").alias("to"), F.col("_rest").alias("left"))
    state = written(state.select("_key", "_to", (F.col("_rest") - F.col("_to")).alias("_left"), F.array(first).alias("_spans")), folder, "part-0")
    rows, k = some.drop("_rest"), 0
    while True:
        k += 1
        fits = rows.join(state.select("_key", "_to", "_left"), "_key").filter((F.col("_end") > F.col("_to")) & (F.col("size") <= F.col("_left")))
        rows = written(fits.select("_key", "_block", "size", "_end", "_left"), folder, f"fits-{k}")
        if rows.isEmpty():
            break
        blocks = rows.groupBy("_key", "_block").agg(F.sum("size").alias("_words"), F.max("_end").alias("_last"), F.first("_left").alias("_left"))
        run = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
        blocks = written(blocks.withColumn("_sum", F.sum("_words").over(run)), folder, f"sums-{k}")  # BLOCKS rows a source at most
        whole = blocks.filter(F.col("_sum") <= F.col("_left")).select("_key", F.col("_last").alias("_to"), F.col("_sum").alias("_used"))
        cut = blocks.filter((F.col("_sum") > F.col("_left")) & (F.col("_sum") - F.col("_words") <= F.col("_left"))).select("_key", "_block", (F.col("_sum") - F.col("_words")).alias("_used"))
        inner = Window.partitionBy("_key").orderBy("_end").rowsBetween(Window.unboundedPreceding, 0)
        parts = rows.join(cut, ["_key", "_block"]).withColumn("_used", F.col("_used") + F.sum("size").over(inner)).filter(F.col("_used") <= F.col("_left"))
        step = whole.unionByName(parts.select("_key", F.col("_end").alias("_to"), "_used")).groupBy("_key").agg(F.max("_to").alias("_next"), F.max("_used").alias("_used"))
        span = F.struct(F.col("_to").alias("from"), F.col("_next").alias("to"), F.col("_left").alias("left"))
        moved = state.join(step, "_key", "left").select("_key", F.coalesce("_next", "_to").alias("_to"), (F.col("_left") - F.coalesce("_used", F.lit(0))).alias("_left"), F.when(F.col("_next").isNull(), F.col("_spans")).otherwise(F.array_append("_spans", span)).alias("_spans"))
        state = written(moved, folder, f"part-{k}")
        rows = rows.drop("_left")
    # what isn't taken has more words than are left
    after = some.join(state, "_key").filter((F.col("_left") > 0) & (F.col("size") > F.col("_left")) & (F.col("size") < 2 * F.col("_left")))
    after = after.filter(~F.exists("_spans", lambda e: (F.col("_end") > e["from"]) & (F.col("_end") <= e["to"]) & (F.col("size") <= e["left"])))
    return state.select("_key", "_spans"), after.groupBy("_key").agg(F.min(F.struct("size", "_end"))["_end"].alias("_over"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """What the mix takes of every row: doc_id, size, source_size, target, taken, copies.

    copies: a (pass, shard, place) for each time the document is taken, pass 0
    being the partial one; place orders the documents of a shard.  There are
    ``shards`` shards, or more if the mix is large.  Null text has
    no words and is never taken; null is a source of its own; repeated rows are
    taken each.  Documents are taken whole.  Equal inputs give equal plans."""
    folder = workspace(docs.sparkSession, "mix")
    return _planned(written(docs.select(*_numbered()), folder, "rows"), folder, weights, cap, shards, seed).drop("_id")


def _planned(rows: DataFrame, folder: str, weights: tuple[float, ...], cap: int, shards: int, seed: int) -> DataFrame:
    """As ``plan_mix``, with _id, from written rows of ``_numbered``."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = shards_for(total, shards)
    bits = int(math.log2(max(BLOCKS, SHARE * shards)))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_text"))
    rows = rows.select("_id", "doc_id", "_key", "size", order.alias("_order")).withColumn("_block", F.shiftrightunsigned("_order", 64 - bits).cast("int"))
    blocks = rows.groupBy("_key", "_block").agg(F.sum("size").alias("words"))
    blocks = written(blocks, folder, "blocks")  # 2**bits rows a source at most
    sources = blocks.groupBy("_key").agg(F.sum("words").alias("source_size"))
    wanted = targets(sources, weights, cap)
    quota = F.round("target").cast("long")
    empty = F.col("source_size") == 0
    wanted = wanted.select("_key", "source_size", "target", F.when(empty, 0).otherwise(F.floor(quota / F.greatest("source_size", F.lit(1)))).cast("long").alias("_passes"), F.when(empty, 0).otherwise(quota % F.greatest("source_size", F.lit(1))).cast("long").alias("_rest"))
    wanted = written(wanted, folder, "targets")
    start = F.coalesce(F.sum("words").over(Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_key", "_block", start.alias("_start")).join(wanted, "_key")
    inside = Window.partitionBy("_key", "_block").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts, ["_key", "_block"]).withColumn("_end", F.col("_start") + F.sum("size").over(inside)).drop("_start")
    placed = written(placed, folder, "placed")

    spans, over = _partial(placed, folder)
    inside_span = F.exists("_spans", lambda e: (F.col("_end") > e["from"]) & (F.col("_end") <= e["to"]) & (F.col("size") <= e["left"]))
    part = (F.coalesce(inside_span, F.lit(False)) | F.coalesce(F.col("_end") == F.col("_over"), F.lit(False))) & (F.col("size") > 0)
    taken = placed.join(spans, "_key", "left").join(over, "_key", "left").withColumn("_part", part).drop("_spans", "_over", "_end", "_rest")
    taken = written(taken, folder, "taken")

    passes = F.when(F.col("_passes") > 0, F.sequence(F.lit(1).cast("long"), F.col("_passes"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    used = taken.groupBy("_key", "_block").agg(F.first("_passes").alias("_passes"), F.max("_part").alias("_any"))
    copies = used.select("_key", "_block", F.explode(F.when(F.col("_any"), F.array_append(passes, F.lit(0).cast("long"))).otherwise(passes)).alias("pass"))
    permuted = Window.partitionBy("_key").orderBy(F.xxhash64(F.lit(seed), F.col("_block"), F.col("pass")), "_block", "pass")
    copies = written(copies.withColumn("_index", F.row_number().over(permuted).cast("long") - 1), folder, "copies")
    split = split_quotas(copies.groupBy("_key").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    split = written(split, folder, "split")
    before = F.coalesce(F.sum("quota").over(Window.partitionBy("_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = split.withColumn("_from", before).select("_key", "shard", F.explode(F.sequence("_from", F.col("_from") + F.col("quota") - 1)).alias("_index"))
    held = copies.join(drawn, ["_key", "_index"]).groupBy("_key", "_block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("_copies"))
    mine = F.filter(F.coalesce("_copies", F.expr("cast(array() as array<struct<pass: bigint, shard: int>>)")), lambda c: (F.col("size") > 0) & ((c["pass"] > 0) | F.col("_part")))
    place = F.transform(mine, lambda c: F.struct(c["pass"].alias("pass"), c["shard"].alias("shard"), F.xxhash64(F.lit(seed), c["shard"], c["pass"], F.col("_order")).alias("place")))
    out = taken.join(held, ["_key", "_block"], "left").withColumn("copies", place)
    return out.select("_id", "doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix itself: the columns of ``docs`` in a row for each copy that is taken.

    Each shard is one partition, its rows in order of place: written down, the
    files follow each other as the shards do.  The rows are written once with a
    number each, which then finds them again; rows that are alike stay apart."""
    folder = workspace(docs.sparkSession, "mixed")
    kept = written(docs.select(whole_row(docs).alias("_row"), *_numbered()), folder, "rows")
    plan = _planned(kept.drop("_row"), folder, weights, cap, shards, seed).filter("taken > 0")
    copies = written(plan.select("_id", F.explode("copies").alias("c")).select("_id", "c.shard", "c.place", "c.pass"), folder, "drawn")
    last = copies.agg(F.max("shard")).first()[0]
    placed = kept.select("_id", "_row").join(copies, "_id")
    return placed.repartitionById((last or 0) + 1, "shard").sortWithinPartitions("shard", "place", "pass", "_id").select("_row.*")
