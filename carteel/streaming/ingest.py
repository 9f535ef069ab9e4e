"""Incremental intake of detections: an extension of our own, as the batch operators see whole tables.

New files become micro-batches.  What a batch adds is thinned against what is
there already, so running a batch again adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import spatial
from ..sources.text import exists

DETECTIONS = "map_id string, id long, px double, py double, confidence double"


def merge_batch(batch: DataFrame, store: str, radius: float = 10.0, least: float = 0.6) -> None:
    """Append the rows of a batch that are confident and farther than ``radius`` from all that is stored.

    The store has a folder for each map; a batch reads those of its own maps only
    (by a join on the partition column, which prunes at run time)."""
    spark = batch.sparkSession
    old = spark.read.schema(DETECTIONS).parquet(store) if exists(spark, store) else spark.createDataFrame([], DETECTIONS)
    good = batch.filter(F.col("confidence") >= least)
    mine = old.join(good.select("map_id").distinct(), "map_id", "left_semi").select("map_id", F.col("px").alias("qx"), F.col("py").alias("qy"))
    fresh = spatial.thin_new(good, mine, radius)
    rows = fresh.join(good.select("map_id", "id", "confidence"), ["map_id", "id"]).dropDuplicates(["map_id", "id"])
    rows.select(*[c.split()[0] for c in DETECTIONS.split(", ")]).write.mode("append").partitionBy("map_id").parquet(store)


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, radius: float = 10.0) -> StreamingQuery:
    """Start reading detections (JSON lines) from ``folder``: everything that is there, then stop."""
    stream = spark.readStream.schema(DETECTIONS).json(folder)
    return stream.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, store, radius)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, map_id, n, mean_confidence) for each window; rows later than ``late`` are left out.  events: ts, map_id, confidence."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = timed.groupBy(F.window("ts", window), "map_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
    return got.select(F.col("window.start").alias("start"), "map_id", "n", "mean_confidence")
