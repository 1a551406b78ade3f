"""Ordered state within a partition: runs, carried labels, neighbours, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine

#: Depth of a valley below the mean, and the least similarity within a segment.
VALLEY_STD, SEGMENT_CUT = 0.5, 0.65


def _over(by: list[str], order: list[str]):
    return W.partitionBy(*by).orderBy(*order)


def islands(df: DataFrame, by: list[str], order: list[str], value: Column, name: str = "island") -> DataFrame:
    """Numbers runs of consecutive equal values from 1."""
    w = _over(by, order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w)).drop("_changed")


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, so far."""
    w = _over(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """chunk_index from 1 and chunk_total."""
    return df.withColumn("chunk_index", F.row_number().over(_over(by, order))).withColumn("chunk_total", F.count(F.lit(1)).over(W.partitionBy(*by)))


def running_count(df: DataFrame, by: list[str], order: list[str], of: Column, name: str) -> DataFrame:
    """How many rows so far are of a kind."""
    w = _over(by, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(F.when(of, 1).otherwise(0)).over(w))


def neighbours(df: DataFrame, by: list[str], order: list[str], vector: str, places: int = 6) -> DataFrame:
    """similarity of each row with the next one; null for the last."""
    following = F.lead(vector).over(_over(by, order))
    return df.withColumn("_next", following).withColumn("similarity", F.round(F.when(F.col("_next").isNotNull(), cosine(F.col(vector), F.col("_next"))), places)).drop("_next")


def valleys(df: DataFrame, by: list[str], order: list[str], similarity: str = "similarity") -> DataFrame:
    """is_boundary: the row after a strict local minimum that lies VALLEY_STD deviations below the mean; ends never count."""
    w, whole = _over(by, order), W.partitionBy(*by)
    s = F.col(similarity)
    rows = df.withColumn("_low", F.round(F.avg(s).over(whole) - VALLEY_STD * F.stddev_pop(s).over(whole), 6))
    rows = rows.withColumn("_valley", F.coalesce((s < F.lag(s).over(w)) & (s < F.lead(s).over(w)) & (s < F.col("_low")), F.lit(False)))
    return rows.withColumn("is_boundary", F.coalesce(F.lag("_valley").over(w), F.lit(False))).drop("_low", "_valley")


def segments(df: DataFrame, by: list[str], order: list[str], similarity: str = "similarity", cut: float = SEGMENT_CUT) -> DataFrame:
    """segment from 0: a new one begins after a row whose similarity with the next lies below the cut."""
    w = _over(by, order)
    starts = F.when(F.lag(similarity).over(w) < cut, 1).otherwise(0)
    return df.withColumn("_cut", starts).withColumn("segment", F.sum("_cut").over(w)).drop("_cut")


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The n last rows of each partition; order gives the newest first."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def spread_over_runs(df: DataFrame, by: list[str], order: list[str], run_key: Column, value: Column, name: str) -> DataFrame:
    """The first value that isn't null within each run of equal keys, on every row of the run."""
    rows = islands(df, by, order, run_key, "_run")
    w = W.partitionBy(*by, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn(name, F.first(value, ignorenulls=True).over(w)).drop("_run")
