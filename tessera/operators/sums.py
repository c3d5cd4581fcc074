"""Sums of doubles that don't depend on the order of the rows.

A number x is cut at fixed places: with M a power of two well above the sum of all sizes, (x + M) - M keeps x's bits down to the last
one of M, exactly, and what is left is cut again at a lower M. Cuts of one level are multiples of one unit and their sums
stay below 2^53 of these, so every partial sum is exact, whatever Spark adds first. LEVELS cuts leave nothing of
numbers that are less than 2^40 apart in size; what is left beyond is below 2^-80 of the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 5


def exact_sums(df: DataFrame, by: list[str], column: str, name: str = "total") -> DataFrame:
    """by, name: the sum of a column by group, the same in any order of rows and any partitions; without columns to group by, one row.

    Nulls don't count, a group of nulls sums to null, non-finite numbers sum as doubles do.
    """
    x = F.col(column).cast("double")
    finite = F.abs(x) < float("inf")
    rows = df.select(*by, F.when(finite, x).otherwise(F.when(x.isNotNull(), 0.0)).alias("_x_"), F.when(~finite, x).alias("_odd_"))
    scale = rows.groupBy(*by).agg(F.max(F.abs("_x_")).alias("_most_"), F.count("_x_").alias("_n_"), F.sum("_odd_").alias("_odd_"))
    bits = F.ceil(F.log2(F.greatest(F.col("_n_"), F.lit(1)).cast("double"))) + 2  # that a level loses to the sum's growth
    top = F.ceil(F.log2(F.greatest(F.col("_most_"), F.lit(1e-290)))) + bits
    scale = scale.select(*by, "_n_", "_odd_", bits.alias("_bits_"), top.alias("_top_"))
    met = rows.drop("_odd_")
    if by:
        keys = scale.select(*[F.col(c).alias(f"_k{i}_") for i, c in enumerate(by)], "_n_", "_odd_", "_bits_", "_top_")
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & met[c].eqNullSafe(keys[f"_k{i}_"])
        met = met.join(keys, same).drop(*[f"_k{i}_" for i in range(len(by))])
    else:
        met = met.withColumns({c: F.lit(value).cast(scale.schema[c].dataType) for c, value in scale.first().asDict().items()})
    rest, cuts = F.col("_x_"), []
    for level in range(LEVELS):
        mark: Column = F.pow(F.lit(2.0), F.greatest(F.col("_top_") - level * (52 - F.col("_bits_")), F.lit(-1000)))
        cut = (rest + mark) - mark
        met = met.withColumn(f"_c{level}_", cut)
        cuts.append(f"_c{level}_")
        rest = rest - F.col(f"_c{level}_")
    summed = met.groupBy(*by).agg(F.max("_n_").alias("_n_"), F.max("_odd_").alias("_odd_"), *[F.sum(c).alias(c) for c in cuts])
    # The levels' sums, from the smallest on.
    total = F.col(cuts[-1])
    for c in reversed(cuts[:-1]):
        total = F.col(c) + total
    return summed.select(*by, F.when(F.col("_n_") > 0, F.coalesce("_odd_", total)).alias(name))
