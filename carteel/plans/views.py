"""Map-registration views over the supplied business tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_obs": """
        SELECT l_suppkey AS map_id, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_extendedprice AS k4,
               (l_partkey % 2000) * 7.0e0 AS px, l_extendedprice / 10 AS py, l_discount * 10 AS confidence,
               0.85e0 * ((l_partkey % 2000) * 7.0e0) - 0.001e0 * (l_extendedprice / 10) + 189000 + (l_quantity - 25) / 5
                 + CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 300 ELSE 0 END AS x,
               0.002e0 * ((l_partkey % 2000) * 7.0e0) - 0.84e0 * (l_extendedprice / 10) + 630000 + (l_quantity - 25) / 7 AS y
        FROM lineitem""",
    "v_geo": """
        SELECT c_custkey AS pid, c_name AS name, 150000e0 + (c_custkey % 500) * 100 AS easting, 600000e0 + c_acctbal * 5 AS northing,
               600000e0 + c_acctbal * 5 + 500000 AS old_e, 100000e0 + (c_custkey % 500) * 100 AS old_n, floor(abs(c_acctbal)) * 1e0 AS height
        FROM customer""",
    "v_extent": """
        SELECT n_nationkey AS map_id, 150000e0 + n_nationkey * 2000 AS min_x, 156000e0 + n_nationkey * 2000 AS max_x,
               600000e0 + n_regionkey * 5000 AS min_y, 615000e0 + n_regionkey * 5000 AS max_y
        FROM nation""",
    "v_label": """
        SELECT CAST(floor(p_partkey / 40e0) AS BIGINT) AS map_id, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS edge, p_partkey AS id,
               910e0 + p_size * 1176e0 + (p_retailprice - 950) / 5 AS pos,
               CAST(CASE WHEN p_type = 'ECONOMY' THEN 50 + (p_partkey * 13) % 60 ELSE 180 - p_size END AS BIGINT) AS val,
               CASE WHEN p_type = 'ECONOMY' THEN 0.4e0 ELSE 0.9e0 END AS conf, 'northing' AS axis
        FROM part""",
    "v_truth": """
        SELECT o_orderkey % (SELECT count(*) FROM supplier) AS map_id, o_orderkey AS gt, (o_orderkey % 2000) * 7e0 AS qx, o_totalprice / 50 AS qy,
               CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS enable
        FROM orders""",
    "v_scored": """
        SELECT d.doc_id, d.lang, d.source, (d.n_chars % 1000) / 1000e0 AS prob, l.quality AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_name": """
        SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5,
               concat('M', CAST(l_suppkey AS VARCHAR(20)), '_x', CAST(l_partkey AS VARCHAR(20)), '_y', CAST(l_orderkey AS VARCHAR(20)), '_c0.',
                      lpad(CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR(20)), 2, '0'), '.png') AS file_name
        FROM lineitem""",
    "v_sheet": """
        SELECT p_partkey AS k, CASE p_partkey % 4
                 WHEN 0 THEN concat(lpad(CAST(p_size AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(p_partkey % 100 AS VARCHAR(20)), 2, '0'), '-Town-1942.jpg')
                 WHEN 1 THEN concat(lpad(CAST(p_size AS VARCHAR(20)), 2, '0'), lpad(CAST(p_size + 1 AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(p_partkey % 100 AS VARCHAR(20)), 2, '0'), '-Town-1942.jpg')
                 WHEN 2 THEN concat(lpad(CAST(p_size AS VARCHAR(20)), 2, '0'), '-', lpad(CAST((p_partkey + 1) % 100 AS VARCHAR(20)), 2, '0'), lpad(CAST(p_partkey % 100 AS VARCHAR(20)), 2, '0'), '-Town-1948.tif')
                 ELSE concat('M', CAST(p_size AS VARCHAR(20)), '_', CAST(p_partkey AS VARCHAR(20)), '.jpg') END AS file_name
        FROM part""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame: its SQL over the tables' files."""
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    front = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {front},\n{body[5:]}"
    return f"WITH {front}\n{body}"
