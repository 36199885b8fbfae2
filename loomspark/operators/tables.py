"""Keeping tables up to date: content-addressed differences, gaps, pruning, pages and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, status): added, removed or unchanged; keys are content hashes, so nothing else can change."""
    o, n = old.select(key).distinct().withColumn("was", F.lit(True)), new.select(key).distinct().withColumn("is", F.lit(True))
    both = o.join(n, key, "full_outer")
    return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("unchanged").alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The new state: known rows as they were, new rows added, vanished rows gone; of equal new keys one."""
    kept = old.join(new.select(key), key, "left_semi")
    added = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    return kept.unionByName(added)


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float], by: str | None = None) -> DataFrame:
    """Upper nearest-rank quantiles: the value at index ``int(n * share)`` of the sorted values."""
    groups = [by] if by else []
    counts = rows.groupBy(*groups, F.col(value).alias("v")).agg(F.count("*").alias("c"))  # distinct values, then a running count
    order = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("v")
    run = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    picks = [F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(name) for name, p in shares.items()]
    return run.groupBy(*groups).agg(F.max("n").alias("n"), *picks, F.max("v").alias("max"), F.sum(F.col("v") * F.col("c")).alias("total"))


def page(rows: DataFrame, *order, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def log_statistics(log: DataFrame, slow: float) -> DataFrame:
    """One row over a query log (mode, value): counts, rates, means."""
    n = F.count("*")
    return log.agg(
        n.alias("queries"),
        F.count_if(F.col("mode") == "error").alias("fallbacks"),
        F.round(F.count_if(F.col("mode") == "error") / n, 6).alias("fallback_rate"),
        F.count_if(F.col("value") > slow).alias("over_budget"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.countDistinct("user").alias("users"),
    )
