"""First come, first served over shared identities."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint

KEYS = ["kind", "value"]


def _follow(links: DataFrame) -> DataFrame:
    """(row_id, end, flips) for links (row_id, next): the row where the chain of links ends, and how many steps away it is, modulo two.
    The step doubles each round."""
    c = F.col
    chains = checkpoint(links.select("row_id", c("next").alias("end"), F.lit(1).alias("flips")))
    while True:
        ahead = chains.select(c("row_id").alias("end"), c("end").alias("_end"), c("flips").alias("_flips"))
        step = checkpoint(chains.join(ahead, "end", "left"))
        if step.filter("_end IS NOT NULL").isEmpty():
            return chains
        chains = step.select("row_id", F.coalesce("_end", "end").alias("end"), ((c("flips") + F.coalesce("_flips", F.lit(0))) % 2).alias("flips"))


def first_come(asked: DataFrame, offered: DataFrame, on_round: Callable[[int], None] | None = None) -> DataFrame:
    """(row_id) of the rows taken, in the order of row_id: a row is taken unless one of the identities it asks for (row_id, kind, value) is
    offered by a row taken before it. A row without questions is taken.

    Of the rows left, those before which no other offers what they ask for are taken. A row with a single such row before it is taken if
    and only if that one is not; chains of them are followed by doubling, so a chain of n rows is decided in one round of log n steps.
    Rows with several wait for the next round. Per identity only its first two offers matter, so a hot identity collapses in a round; its
    rows meet in sort-merge joins, which adaptive execution splits.
    """
    c = F.col
    asked, offered = checkpoint(asked.distinct()), checkpoint(offered.distinct())
    taken, rounds = None, 0
    while True:
        rounds += 1
        if on_round:
            on_round(rounds)
        rows = asked.select("row_id").union(offered.select("row_id")).distinct()
        first = offered.groupBy(*KEYS).agg(F.min("row_id").alias("first"))
        second = offered.join(first, KEYS).filter("row_id > first").groupBy(*KEYS).agg(F.min("row_id").alias("second"))
        met = asked.join(first.join(second, KEYS, "left"), KEYS).filter("first < row_id")
        ahead = met.groupBy("row_id").agg(F.min("first").alias("low"), F.max("first").alias("high"),
                                          F.bool_or(F.coalesce(c("second") < c("row_id"), F.lit(False))).alias("crowded"))
        state = checkpoint(rows.join(ahead, "row_id", "left"))
        ready = state.filter("low IS NULL").select("row_id")
        if state.filter("low IS NOT NULL").isEmpty():
            return ready if taken is None else taken.union(ready)
        chains = _follow(state.filter("low = high AND NOT crowded").select("row_id", c("low").alias("next")))
        decided = chains.join(ready.select(c("row_id").alias("end")), "end").select("row_id", (c("flips") == 0).alias("take"))
        decided = checkpoint(decided.union(ready.select("row_id", F.lit(True).alias("take"))))
        new = decided.filter("take").select("row_id")
        taken = new if taken is None else checkpoint(taken.union(new))
        given = offered.join(new, "row_id").groupBy(*KEYS).agg(F.min("row_id").alias("giver"))
        refused = asked.join(given, KEYS).filter("row_id > giver").select("row_id")
        done = decided.select("row_id").union(refused).distinct()
        asked, offered = (checkpoint(table.join(done, "row_id", "left_anti")) for table in (asked, offered))
