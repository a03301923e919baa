"""Candidate order, top lists, watchlist, default view, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint


def candidate_order() -> list[Column]:
    """Best score, then youngest, then fewest responses, then key; unknown values last."""
    return [F.desc("score"), F.asc_nulls_last("age_hours"), F.asc_nulls_last("responses_count"), F.asc("key")]


def top(candidates: DataFrame, n: int = 10) -> DataFrame:
    return candidates.filter("eligible").orderBy(*candidate_order()).limit(n)


def watchlist(candidates: DataFrame) -> DataFrame:
    """Just below the mark, or scored in spite of a stack mismatch."""
    near = (F.col("label") == "GOOD") & (F.col("score") == 6)
    return candidates.filter(near | (F.col("scored") & F.array_contains("risk_flags", "STACK_MISMATCH")))


def default_view(candidates: DataFrame, skips: int = 5) -> DataFrame:
    """Everything worth a look and the first few skipped rows. The candidates are written, so that they are assessed once for both; pass
    narrow rows."""
    candidates = checkpoint(candidates)
    skipped = candidates.filter("label = 'SKIP'").orderBy(*candidate_order()).limit(skips)
    return candidates.filter("label <> 'SKIP'").unionByName(skipped)


def top_per_source(candidates: DataFrame, n: int = 20) -> DataFrame:
    """Best `n` per source by score and age (the rank filter is applied before the shuffle as well)."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), F.asc_nulls_last("age_hours"), F.asc("row_id"))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def first_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """First `n` rows of each group in a given order."""
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def latest_per_key(rows: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """One row per key with the values at the highest `order`; partial maxima are taken before the shuffle."""
    packed = F.struct(*columns)
    return rows.groupBy(key).agg(F.max_by(packed, order).alias("_v")).select(key, "_v.*")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add `rank`, the 1-based position in the total order.

    Rows are written, as sampling for the ranges reads them twice, range-partitioned and checkpointed, then numbered inside each
    partition and shifted by the sizes of the partitions before it: no task sees more than its own range. Pass narrow rows.
    """
    parts = checkpoint(checkpoint(rows).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset")
