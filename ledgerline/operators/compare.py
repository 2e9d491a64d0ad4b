"""Comparison of runs: two keyed sets, dimension by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, REMOVED, CHANGED, SAME = "ADDED", "REMOVED", "CHANGED", "SAME"
UNCHANGED, DIFFERENT, NOT_COMPARABLE = "SAME", "CHANGED", "NOT_COMPARABLE"


def map_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", into: str = "change") -> DataFrame:
    """Full outer join of two keyed sets: keys, value_a, value_b and how the key changed.

    A null value that is there differs from a key that is not.
    """
    left = a.select(*keys, F.col(value).alias("value_a"), F.lit(True).alias("in_a"))
    right = b.select(*keys, F.col(value).alias("value_b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), ADDED).when(F.col("in_b").isNull(), REMOVED).when(~F.col("value_a").eqNullSafe(F.col("value_b")), CHANGED).otherwise(SAME)
    return left.join(right, keys, "full_outer").select(*keys, "value_a", "value_b", change.alias(into))


def dimension(diff: DataFrame, name: str, blocked: Column | None = None) -> DataFrame:
    """One row: dimension, examined, differences, verdict. A blocked dimension is never called the same."""
    n = F.count_if(F.col("change") != SAME)
    why = F.max(blocked) if blocked is not None else F.lit(None).cast("string")
    counted = diff.agg(F.count("*").alias("examined"), n.alias("differences"), why.alias("blocked"))
    verdict = F.when(F.col("differences") > 0, DIFFERENT).when(F.col("blocked").isNotNull(), NOT_COMPARABLE).otherwise(UNCHANGED)
    return counted.select(F.lit(name).alias("dimension"), "examined", "differences", "blocked", verdict.alias("verdict"))


def settled(dimensions: DataFrame) -> DataFrame:
    """One row: whether every dimension is the same, and the exit code."""
    return dimensions.agg(F.coalesce(F.bool_and(F.col("verdict") == UNCHANGED), F.lit(False)).alias("settled")).withColumn("exit_code", F.when(F.col("settled"), 0).otherwise(1))


def material(a: Column, b: Column, floor: float, share: float = 0.05) -> Column:
    """Whether two figures differ by more than a share of the larger one and more than a floor; null where one is missing."""
    gap = F.abs(a - b)
    return F.when(a == b, False).otherwise((gap > F.greatest(F.abs(a), F.abs(b)) * share) & (gap > floor))


def package_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Packages (name, version) of two environments: in one alone, or at another version; equal ones are left out."""
    return map_diff(a, b, ["name"], "version").filter(F.col("change") != SAME)
