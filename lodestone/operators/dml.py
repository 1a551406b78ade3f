"""Changes to keyed tables, as new tables: upsert, insert, delete, update, and what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """new replaces old by key; of several new rows of a key the one that ``newest`` puts first."""
    return old.join(new, keys, "left_anti").unionByName(_last(new, keys, newest))


def upsert_changed(old: DataFrame, new: DataFrame, keys: list[str], newest: list[Column], stamp: str, now: Column) -> DataFrame:
    """upsert in which ``stamp`` of a replaced row moves to ``now`` only where another column differs; new keys are stamped too.

    Columns differ where one is null and the other isn't. old has stamp, new need not.
    """
    values = [c for c in old.columns if c != stamp]
    rest = [c for c in values if c not in keys]
    last = _last(new.select(*values), keys, newest)
    held = old.select(*keys, F.struct(*rest, F.lit(1).alias("_")).alias("_was"), F.col(stamp).alias("_stamp"))
    both = last.join(held, keys, "left")
    same = F.struct(*rest, F.lit(1).alias("_")).eqNullSafe(F.col("_was"))
    moved = both.select(*values, F.when(same, F.col("_stamp")).otherwise(now).alias(stamp)).select(*old.columns)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(moved)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], oldest: list[Column]) -> DataFrame:
    """old and those new rows whose key it lacks; the first of several."""
    return old.unionByName(added(old, new, keys, oldest))


def added(old: DataFrame, new: DataFrame, keys: list[str], oldest: list[Column]) -> DataFrame:
    """The rows that insert_absent would add."""
    return _last(new.join(old, keys, "left_anti"), keys, oldest)


def unseen(incoming: DataFrame, registry: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Incoming rows whose key is not registered, or not at this version."""
    on = keys + ([version] if version else [])
    return incoming.join(registry.select(*on).distinct(), on, "left_anti")


def status(incoming: DataFrame, registry: DataFrame, key: str, digest: str, force: bool = False) -> DataFrame:
    """new, updated, or skipped, by the digest held for the key."""
    held = registry.select(key, F.col(digest).alias("_held"))
    state = F.when(F.col("_held").isNull(), "new").when(F.lit(force) | (F.col("_held") != F.col(digest)), "updated").otherwise("skipped")
    return incoming.join(held, key, "left").withColumn("status", state).drop("_held")


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(parent: DataFrame, children: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """parent and each child without the rows of the keys in gone."""
    return {"parent": delete(parent, gone, keys)} | {name: delete(df, gone, keys) for name, df in children.items()}


def update(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})
