"""A road network and a timetable derived from the star-schema tables, by integer arithmetic only.

Customers are the nodes and orders the directed edges of a graph; line items
are the calls of trips at stops; events are positions of traces.  The same
definitions, as SQL, are in ``BASE_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.session import table


def node_count(spark: SparkSession, d: str) -> Column:
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n")).scalar()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node, lat_e7, lon_e7, nation)"""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("node"), (F.lit(470_000_000) + (k * 7919 % 10_000) * 100).alias("lat_e7"), (F.lit(80_000_000) + (k * 104_729 % 10_000) * 100).alias("lon_e7"), F.col("c_nationkey").alias("nation"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(edge, src, dst, w, road_class, road_env, year); loops are left out."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("edge"), F.col("o_custkey").alias("src"), ((k * 7919 + 13) % node_count(spark, d)).alias("dst"), F.floor("o_totalprice").cast("bigint").alias("w"),
        F.translate(F.substring("o_orderpriority", 3, 100), " ", "_").alias("road_class"), F.col("o_orderstatus").alias("road_env"), F.year("o_orderdate").alias("year"),
    )
    return rows.filter("src <> dst")


def directed(edges: DataFrame, weight: Column, reverse: bool = False) -> DataFrame:
    """(base, adj, edge, w) for searches; ``reverse`` walks against the edges.  Edges of null weight cannot be used."""
    base, adj = ("dst", "src") if reverse else ("src", "dst")
    return edges.select(F.col(base).alias("base"), F.col(adj).alias("adj"), "edge", weight.cast("bigint").alias("w")).filter(F.col("w").isNotNull())


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(trip, seq, stop, arrival_s, dep_s): a timetable out of line items; seq runs over all columns, as lines may tie."""
    from pyspark.sql import Window

    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*cols))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), seq.alias("seq"))
    start = F.col("l_orderkey") * 37 % 72_000
    return rows.select(F.col("l_orderkey").alias("trip"), "seq", F.col("l_suppkey").alias("stop"), (start + F.col("seq") * 600).alias("arrival_s"), (start + F.col("seq") * 600 + F.col("q")).alias("dep_s"))


BASE_SQL = """
cnt AS (SELECT count(*) AS n FROM customer),
nodes AS (SELECT c_custkey AS node, 470000000 + (c_custkey * 7919 % 10000) * 100 AS lat_e7, 80000000 + (c_custkey * 104729 % 10000) * 100 AS lon_e7, c_nationkey AS nation FROM customer),
edges AS (SELECT o_orderkey AS edge, o_custkey AS src, (o_orderkey * 7919 + 13) % (SELECT n FROM cnt) AS dst, CAST(floor(o_totalprice) AS BIGINT) AS w,
  replace(substr(o_orderpriority, 3), ' ', '_') AS road_class, o_orderstatus AS road_env, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_custkey <> (o_orderkey * 7919 + 13) % (SELECT n FROM cnt)),
calls AS (SELECT l_orderkey AS trip, seq, l_suppkey AS stop, l_orderkey * 37 % 72000 + seq * 600 AS arrival_s, l_orderkey * 37 % 72000 + seq * 600 + q AS dep_s FROM (
  SELECT l_orderkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM lineitem))
"""
