"""Set operations on inventories: as arrays of a row and as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersection(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def missing_keys(wanted: Sequence[str], available: Sequence[str]) -> None:
    """Raise if something wanted is not available."""
    lacking = sorted(set(wanted) - set(available))
    if lacking:
        raise KeyError(f"not available: {lacking}")


def union_unique(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """UNION ALL whose repeated keys are an error when read."""
    both = a.unionByName(b)
    twice = both.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    checked = both.join(twice, F.col(key).eqNullSafe(F.col("_k")))
    fine = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated "), F.col(key).cast("string"))))
    return checked.withColumn(key, fine).drop("_k", "_n")


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
