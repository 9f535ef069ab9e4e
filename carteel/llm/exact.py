"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Rows are combined three times, each time comparing digest and full content:
within a map task (partial aggregation), within a digest's salted group, and,
for the few digests that were salted, over their salts.  Only frequent digests
are salted.  A digest is frequent from ``1 / HOT_SHARE`` of all rows on, so
there are never more than ``HOT_SHARE`` of them, which bounds every broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import HOT_SHARE, whole_row, workspace, written

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _hot(rows: DataFrame, total: int, least: int) -> DataFrame:
    """Digests with at least max(least, total / HOT_SHARE) rows: HOT_SHARE at most."""
    return rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= F.lit(max(least, -(-total // HOT_SHARE)))).select("_digest", F.lit(True).alias("_hot"))


def _combined(rows: DataFrame, hot: DataFrame, aggs: list[Column], merged: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(cold, hot): one row for each distinct (digest, text)."""
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_row"), F.lit(SALTS))).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(hot), "_digest", "left").withColumn("_salt", salt)
    first = salted.groupBy("_digest", "_salt", "_hot", "_text").agg(*aggs)
    cold = first.filter(F.col("_hot").isNull()).drop("_salt", "_hot")
    return cold, first.filter(F.col("_hot")).groupBy("_digest", "_text").agg(*merged)


def _rows(docs: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("_row"), text.alias("_text")).withColumn("_digest", digest(F.col("_text")))


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[Column], Column] = sha256, least_hot: int = 1000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_digest) for every row of ``docs``.

    Texts are equal when their characters are; null counts as empty.  The row
    with the largest doc_id of a group stays; rows that share that doc_id and
    text all have kept = true.  A null doc_id is less than any other.  Other
    columns aren't read.  Two texts with one digest stay two groups."""
    folder = workspace(docs.sparkSession, "exact")
    rows = _rows(docs, id_column, text_column, digest)
    total = docs.count()
    hot = written(_hot(rows, total, least_hot), folder, "hot")
    ids = [F.max("_row").alias("_keep"), F.count(F.lit(1)).alias("_size")]
    cold, warm = _combined(rows, hot, ids, [F.max("_keep").alias("_keep"), F.sum("_size").alias("_size")])
    groups = written(cold.unionByName(warm).select("_digest", "_keep", "_size"), folder, "groups")
    clash = groups.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("_digest")

    slim = rows.select("_row", "_digest")
    few = groups.join(F.broadcast(hot), "_digest", "left_semi")
    many = groups.join(F.broadcast(hot), "_digest", "left_anti")
    hot_rows = slim.join(F.broadcast(hot), "_digest", "left_semi")
    cold_rows = slim.join(F.broadcast(hot), "_digest", "left_anti")
    if clash.isEmpty():
        member = cold_rows.join(many, "_digest").unionByName(hot_rows.join(F.broadcast(few), "_digest"))
    else:  # a digest that stands for several texts: their rows are told apart by content
        alone = groups.join(clash, "_digest", "left_anti")
        unclear = rows.join(clash, "_digest", "left_semi")
        texts = unclear.groupBy("_digest", "_text").agg(*ids)
        member = slim.join(alone, "_digest").unionByName(unclear.join(texts, ["_digest", "_text"]).select("_digest", "_row", "_keep", "_size"))
    return member.select(
        F.col("_row").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_row").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("text_digest"),
    )


def distinct_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_hot: int = 1000) -> DataFrame:
    """The rows that stay, with all columns of ``docs``: one for each distinct text, that with the largest doc_id
    (of rows with that doc_id and text, one).  Null and empty texts are one group."""
    folder = workspace(docs.sparkSession, "distinct")
    hot = written(_hot(_rows(docs, id_column, text_column, sha256), docs.count(), least_hot), folder, "hot")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    row = whole_row(docs.drop(text_column)) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("none"))
    # the names below stand beside one struct with all other columns of the table, so none can clash
    rows = docs.select(F.col(id_column).cast("long").alias("_row"), text.alias("_text"), F.struct(row.alias("rest"), F.col(text_column).isNull().alias("empty")).alias("_rest"))
    rows = rows.withColumn("_digest", sha256(F.col("_text")))
    order = F.struct("_row", F.xxhash64("_rest") if "map<" not in rows.schema["_rest"].dataType.simpleString() else F.lit(0))
    cold, warm = _combined(rows, hot, [F.max_by("_rest", order).alias("_best"), F.max(order).alias("_order")], [F.max_by("_best", "_order").alias("_best")])
    best = cold.drop("_order").unionByName(warm)
    out = {c: F.col(f"_best.rest.`{c}`") for c in docs.columns} | {text_column: F.when(~F.col("_best.empty"), F.col("_text")).cast(docs.schema[text_column].dataType)}
    return best.select(*[out[c].alias(c) for c in docs.columns])
