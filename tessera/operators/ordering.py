"""Checkpoints, global numbering and Z-order without a single-task sort."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as v


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one on this machine only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df cut from its lineage: written as Parquet below the checkpoint folder and read again.

    Unlike a checkpointed plan, a file tells its true size. Where a loop joins its
    state with itself, estimates that are carried on would square with every round.
    """
    spark = df.sparkSession
    path = folder or f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The states of a loop: each is checkpointed, and then the one it was made from is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}", 0

    def next(self, df: DataFrame) -> DataFrame:
        state = checkpointed(df, f"{self.folder}/{self.count}")
        if self.count:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.count - 1}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.count += 1
        return state


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with 0, 1, 2, ... in the order of columns that together are unique.

    Rows are dealt by range, numbered inside their range and shifted by the sizes
    of the ranges before: one shuffle, and no task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn("_range_", F.spark_partition_id()))
    sizes = ranged.groupBy("_range_").agg(F.count("*").alias("_size_"))  # a row a range
    before = Window.orderBy("_range_").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range_", F.coalesce(F.sum("_size_").over(before), F.lit(0)).alias("_shift_"))
    own = F.row_number().over(Window.partitionBy("_range_").orderBy(*order)) - 1
    return ranged.withColumn("_own_", own).join(F.broadcast(shifts), "_range_").withColumn(name, F.col("_own_") + F.col("_shift_")).drop("_range_", "_own_", "_shift_")


def bounding_box(points: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return points.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def z_order(points: DataFrame) -> DataFrame:
    """points with their Morton key and their place in the order of (key, id)."""
    box = bounding_box(points).first()
    side = lambda n: tuple(F.lit(box[f"{n}_{a}"]) for a in "xyz")
    keyed = points.withColumn("morton", v.morton(v.vec("x", "y", "z"), side("min"), side("max")))
    return numbered(keyed, ["morton", "id"], "place")


def points_per_leaf(points: DataFrame, levels: int) -> DataFrame:
    """leaf, points: how many points each cell of an octree of so many levels over the points' box holds; cells are told by the head of their Morton key."""
    box = bounding_box(points).first()
    side = lambda n: tuple(F.lit(box[f"{n}_{a}"]) for a in "xyz")
    key = v.morton(v.vec("x", "y", "z"), side("min"), side("max"))
    return points.select(F.shiftright(key, 3 * (21 - levels)).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("points"))
