"""Clouds and graphs derived from the relational tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: the first three components are the place, the next three the colour."""
    e = lambda i: F.get("embedding", F.lit(i))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *[e(i).alias(c) for i, c in enumerate("xyz")], *[((e(i + 3) + 1) / 2).cast("float").alias(c) for i, c in enumerate("rgb")], F.lit(1.0).cast("float").alias("a"), (F.col("vec_id") % 7 != 0).alias("alive"), (F.col("vec_id") % 3 == 0).alias("selected"), "label")


CLOUD_EMB = """(SELECT vec_id AS point_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z, CAST((CAST(embedding[4] AS DOUBLE) + 1) / 2 AS FLOAT) AS r, CAST((CAST(embedding[5] AS DOUBLE) + 1) / 2 AS FLOAT) AS g, CAST((CAST(embedding[6] AS DOUBLE) + 1) / 2 AS FLOAT) AS b, CAST(1 AS FLOAT) AS a, vec_id % 7 <> 0 AS alive, vec_id % 3 = 0 AS selected, label FROM embeddings)"""


def cloud_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: price, day and customer make the place."""
    o = table(spark, sf_dir, "orders")
    x, y, z = (F.col("o_totalprice") / 1000).cast("float"), (F.datediff("o_orderdate", F.lit("1995-01-01")) / 10.0).cast("float"), (F.col("o_custkey") % 50).cast("float")
    return o.select(F.col("o_orderkey").alias("point_id"), x.alias("x"), y.alias("y"), z.alias("z"), *[((F.col("o_orderkey") % m) / float(m - 1)).cast("float").alias(c) for c, m in (("r", 11), ("g", 13), ("b", 17))], F.lit(1.0).cast("float").alias("a"), (F.col("o_orderkey") % 7 != 0).alias("alive"), (F.col("o_orderkey") % 5 == 0).alias("selected"))


CLOUD_ORD = """(SELECT o_orderkey AS point_id, CAST(o_totalprice / 1000 AS FLOAT) AS x, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 10.0 AS FLOAT) AS y, CAST(o_custkey % 50 AS FLOAT) AS z, CAST((o_orderkey % 11) / 10.0 AS FLOAT) AS r, CAST((o_orderkey % 13) / 12.0 AS FLOAT) AS g, CAST((o_orderkey % 17) / 16.0 AS FLOAT) AS b, CAST(1 AS FLOAT) AS a, o_orderkey % 7 <> 0 AS alive, o_orderkey % 5 = 0 AS selected FROM orders)"""


def cloud_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: quantity, price and discount; they have no key of their own."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("float").alias("x"), (F.col("l_extendedprice") / 1000).cast("float").alias("y"), (F.col("l_discount") * 100).cast("float").alias("z"), *[(F.col("l_tax") * k).cast("float").alias(c) for c, k in (("r", 10), ("g", 5), ("b", 2))], F.lit(1.0).cast("float").alias("a"))


CLOUD_LI = """(SELECT CAST(l_quantity AS FLOAT) AS x, CAST(l_extendedprice / 1000 AS FLOAT) AS y, CAST(l_discount * 100 AS FLOAT) AS z, CAST(l_tax * 10 AS FLOAT) AS r, CAST(l_tax * 5 AS FLOAT) AS g, CAST(l_tax * 2 AS FLOAT) AS b, CAST(1 AS FLOAT) AS a FROM lineitem)"""


def cloud_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("float").alias("x"), (F.col("p_retailprice") / 100).cast("float").alias("y"), (F.col("p_partkey") % 17).cast("float").alias("z"), (F.col("p_partkey") % 7 != 0).alias("alive"), (F.col("p_partkey") % 3 == 0).alias("selected"))


CLOUD_PART = """(SELECT p_partkey AS point_id, CAST(p_size AS FLOAT) AS x, CAST(p_retailprice / 100 AS FLOAT) AS y, CAST(p_partkey % 17 AS FLOAT) AS z, p_partkey % 7 <> 0 AS alive, p_partkey % 3 = 0 AS selected FROM part)"""

OFFSET = 1_000_000_000


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, and suppliers after them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), (F.col("c_acctbal") / 100).cast("float").alias("x"), F.col("c_nationkey").cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + OFFSET).alias("node_id"), (F.col("s_acctbal") / 100).cast("float").alias("x"), F.col("s_nationkey").cast("float").alias("y"), F.lit(1.0).cast("float").alias("z"))
    return c.unionByName(s)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each order line, from its customer to its supplier."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + OFFSET).alias("dst"))


TRADE_NODES = f"(SELECT c_custkey AS node_id, CAST(c_acctbal / 100 AS FLOAT) AS x, CAST(c_nationkey AS FLOAT) AS y, CAST(0 AS FLOAT) AS z FROM customer UNION ALL SELECT s_suppkey + {OFFSET}, CAST(s_acctbal / 100 AS FLOAT), CAST(s_nationkey AS FLOAT), CAST(1 AS FLOAT) FROM supplier)"
TRADE_EDGES = f"(SELECT o_custkey AS src, l_suppkey + {OFFSET} AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each event, from its user to a user that its id names; some are loops."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("event_id") * 7 % 1000).alias("dst"))


USER_EDGES = "(SELECT user_id AS src, event_id * 7 % 1000 AS dst FROM events)"


def user_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


USER_NODES = f"(SELECT DISTINCT node_id FROM (SELECT src AS node_id FROM {USER_EDGES} UNION ALL SELECT dst FROM {USER_EDGES}))"
