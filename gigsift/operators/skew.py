"""Joining rows back to their groups when one group may hold a large share of all rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 1024  # a group with more than 1 / HOT_SHARE of all rows is split; there are fewer than HOT_SHARE of them
SALTS = 4096


def spread_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str, spread_by: Column, how: str = "left") -> DataFrame:
    """`rows` joined with `groups`, which has one row per key and its number of rows in `weight`.

    Groups above 1 / HOT_SHARE of the total weight reach their rows by broadcast: as weights add up to the total, there are fewer
    than HOT_SHARE of them at any size. Their rows and rows with a NULL key take a salted shuffle key, so that they spread over all
    tasks, while the remaining groups, none of which is hot, join by shuffle.
    """
    keys = list(keys)
    values = [name for name in groups.columns if name not in keys]
    packed = groups.select(*keys, F.struct(*values).alias("_group"))
    total = groups.agg(F.sum(weight).alias("_total")).withColumn("_one", F.lit(1))
    hot = (groups.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").filter(F.col(weight) * HOT_SHARE > F.col("_total"))
           .select(*keys, F.struct(*values).alias("_hot")))
    marked = rows.join(F.broadcast(hot), keys, "left")
    absent = F.lit(False)
    for key in keys:
        absent = absent | F.col(key).isNull()
    salt = F.when(F.col("_hot").isNotNull() | absent, F.pmod(F.xxhash64(spread_by), F.lit(SALTS)) + 1).otherwise(0)
    joined = (marked.withColumn("_salt", salt.cast("int"))
              .join(packed.withColumn("_salt", F.lit(0)), keys + ["_salt"], "left")
              .withColumn("_group", F.coalesce("_hot", "_group")))
    if how == "inner":
        joined = joined.filter(F.col("_group").isNotNull())
    elif how == "left_anti":
        return joined.filter(F.col("_group").isNull()).select(*rows.columns)
    elif how == "left_semi":
        return joined.filter(F.col("_group").isNotNull()).select(*rows.columns)
    return joined.select(*rows.columns, *[F.col(f"_group.{name}").alias(name) for name in values])


def matched_groups(probes: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str = "_n") -> DataFrame:
    """Groups which occur among `probes`, with the number of probes as `weight`. One row per key on both sides."""
    return probes.groupBy(*keys).agg(F.count(F.lit(1)).alias(weight)).join(groups, list(keys))
