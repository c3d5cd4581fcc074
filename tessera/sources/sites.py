"""Sites, fields, rasters, matrices and graphs derived from the given tables.

Every derivation is deterministic and covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as v


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sphere_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z on the unit sphere, f and (gx, gy, gz) fields, of every embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(7)])
    x, y, z = v.unit(v.vec("e0", "e1", "e2"))
    return e.select("id", x.alias("x"), y.alias("y"), z.alias("z"), F.col("e3").alias("f"), F.col("e4").alias("gx"), F.col("e5").alias("gy"), F.col("e6").alias("gz"))


def square_sites(spark: SparkSession, sf_dir: str, name: str = "customer", key: str = "c_custkey", field: str = "c_acctbal") -> DataFrame:
    """id, x, y in the unit square and f of every row of a keyed table."""
    k = F.col(key)
    return table(spark, sf_dir, name).select(
        k.alias("id"), ((k * 7919 % 10007) / 10007.0).alias("x"), ((k * 104729 % 10009) / 10009.0).alias("y"), F.col(field).alias("f")
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return square_sites(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")


def side(df: DataFrame) -> int:
    """Points on a side of the square lattice that has about as many points as df has rows, 2 at least."""
    return max(2, int(df.count() ** 0.5))


RASTER_WIDTH, RASTER_HEIGHT = 64, 32


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, py, value (0-255): all events binned to the pixels of an image by their ids."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return (
        e.groupBy((k % RASTER_WIDTH).cast("int").alias("px"), (F.floor(k / RASTER_WIDTH) % RASTER_HEIGHT).cast("int").alias("py"))
        .agg(F.sum(F.floor("value").cast("long")).alias("total"))
        .select("px", "py", (F.col("total") % 256).cast("int").alias("value"))
    )


def coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, value: quantities of all line items by part and supplier."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: every customer with each of its orders; orders are nodes of their own, numbered below all customers."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (-1 - F.col("o_orderkey")).alias("b"))
