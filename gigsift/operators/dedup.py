"""Duplicates across sources: identity edges, connected components, survivors, safety merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.text import long_title
from ..functions.urls import canonical_url, is_project_link
from ..session import checkpoint
from .normalize import with_identity
from .skew import spread_join


NARROW = ("row_id", "key", "fingerprint", "canonical", "norm_title", "origin_kind", "url", "external_url")


def _edges(rows: DataFrame) -> DataFrame:
    """All identity and title edges. The columns they are made of are written once, without the texts."""
    narrow = checkpoint(rows.select(*NARROW))
    return identity_edges(narrow).union(title_edges(narrow))


def _identified(listings: DataFrame) -> DataFrame:
    return listings if "fingerprint" in listings.columns else with_identity(listings)


def identity_edges(listings: DataFrame) -> DataFrame:
    """(row_id, kind, value): up to four identities of each listing."""
    c = F.col
    external = canonical_url(c("external_url"))
    market = c("origin_kind") == "marketplace"
    telling = c("external_url").isNotNull() | market | long_title(c("norm_title"))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    identities = F.array_compact(F.array(
        pair("key", c("key")),
        F.when(telling, pair("fingerprint", c("fingerprint"))),
        pair("url", c("canonical")),
        F.when(c("external_url").isNotNull() & is_project_link(c("_external")), pair("url", c("_external")))))
    rows = _identified(listings).withColumn("_external", external).withColumn("_identities", F.array_distinct(identities))
    return rows.select("row_id", F.explode("_identities").alias("i")).select("row_id", "i.kind", "i.value")


def title_edges(listings: DataFrame) -> DataFrame:
    """(row_id, kind, value) of long titles which name at most one target and occur outside the marketplaces."""
    c = F.col
    market = c("origin_kind") == "marketplace"
    titled = _identified(listings).filter(long_title(c("norm_title"))).select(
        "row_id", F.col("norm_title").alias("value"), market.alias("_market"),
        F.when(c("external_url").isNotNull() | market, canonical_url(F.coalesce("external_url", "url"))).alias("_target"))
    # "at most one distinct target" is min = max, which needs no distinct set per title
    groups = titled.groupBy("value").agg(
        F.min("_target").alias("_low"), F.max("_target").alias("_high"), F.bool_and("_market").alias("_all_market"),
        F.count(F.lit(1)).alias("_n")).filter(
        (c("_n") > 1) & (c("_low").isNull() | (c("_low") == c("_high"))) & ~c("_all_market")).select("value", "_n")
    members = spread_join(titled.select("row_id", "value"), groups, ["value"], "_n", c("row_id"), "left_semi")
    return members.select("row_id", F.lit("title").alias("kind"), "value")


def _stars(edges: DataFrame) -> DataFrame:
    """(big, small) edges from every row to the smallest row sharing one of its identities."""
    hashed = edges.select("row_id", F.unhex(F.md5(F.concat_ws("\n", "kind", "value"))).alias("identity"))
    hubs = checkpoint(hashed.groupBy("identity").agg(F.min("row_id").alias("small"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    linked = spread_join(hashed, hubs, ["identity"], "_n", F.col("row_id"), "inner")
    return linked.filter("row_id > small").select(F.col("row_id").alias("big"), "small").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a row to the smallest row around it."""
    around = edges.select(F.col("small").alias("u"), F.col("big").alias("v")).union(edges.select("big", "small"))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("u", "m"))
    down = edges.select(F.col("small").alias("u"), F.col("big").alias("v"))
    return (spread_join(down, least, ["u"], "_n", F.col("v"), "inner").filter("v > m")
            .select(F.col("v").alias("big"), F.col("m").alias("small")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a row and its smaller neighbours to the smallest of them."""
    up = edges.select(F.col("big").alias("u"), F.col("small").alias("v"))
    least = up.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    moved = spread_join(up, least, ["u"], "_n", F.col("v"), "inner").filter("v > m").select("v", "m")
    return moved.union(least.select("u", "m")).toDF("big", "small").distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Every row hangs on exactly one root."""
    roles = edges.select(F.col("big").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("small", F.lit(0), F.lit(1)))
    degrees = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degrees.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(row_id, component): the smallest connected row, for rows which share an identity with another row.

    Alternating large-star / small-star contraction (Kiveris et al., 2014). Each round is two aggregations and two joins
    over the remaining edges, each cut by a checkpoint.
    """
    links = checkpoint(_stars(edges))
    while not _is_settled(links):
        wide = checkpoint(_large_star(links))
        links = checkpoint(_small_star(wide))
    roots = links.select(F.col("small").alias("row_id"), F.col("small").alias("component")).distinct()
    return links.select(F.col("big").alias("row_id"), F.col("small").alias("component")).union(roots)


def duplicate_components(listings: DataFrame) -> DataFrame:
    """(row_id, component) for every listing."""
    rows = _identified(listings)
    found = components(_edges(rows))
    return rows.select("row_id").join(found, "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))


def _safety(confirmed_date: Column, market: Column) -> list[Column]:
    """Aggregates behind the merge: first closed copy, and whether confirmed dates differ (NULL is a value)."""
    c = F.col
    closed = market & c("open_status").isin(*vocab.CLOSED_STATUSES)
    return [
        F.min(F.when(closed, F.struct("row_id", "open_status", "status_evidence"))).alias("_closed"),
        F.min(confirmed_date).alias("_first_date"), F.max(confirmed_date).alias("_last_date"),
        F.coalesce(F.bool_or(F.when(market & c("publication_confirmed"), c("published_at").isNull())), F.lit(False)).alias("_no_date"),
    ]


def _merge(rows: DataFrame, groups: DataFrame, winner: Column, conflict: Column) -> DataFrame:
    """Winners of their components with the safety fields applied, and all rows without a component."""
    c = F.col
    chosen = groups.withColumn("row_id", winner).withColumn("_conflict", conflict).select("row_id", "_closed", "_conflict")
    kept = rows.join(chosen.withColumn("_won", F.lit(True)), "row_id", "left").filter(c("component").isNull() | c("_won"))
    clash = F.coalesce("_conflict", F.lit(False))
    merged = kept.withColumns({
        "open_status": F.when(c("_closed").isNotNull(), c("_closed.open_status")).otherwise(c("open_status")),
        "status_evidence": F.when(c("_closed").isNotNull(), c("_closed.status_evidence")).otherwise(c("status_evidence")),
        "publication_evidence": F.when(clash, "conflicting original publication fields").otherwise(c("publication_evidence")),
        "publication_confirmed": c("publication_confirmed") & ~clash})
    return merged.drop("component", "_closed", "_conflict", "_won")


def _dates_differ() -> Column:
    c = F.col
    return F.coalesce(c("_first_date") < c("_last_date"), F.lit(False)) | (c("_no_date") & c("_first_date").isNotNull())


def deduplicate(listings: DataFrame) -> DataFrame:
    """One survivor per duplicate component: marketplace before direct post before repost, dated, longest, first key."""
    c = F.col
    rows = _identified(listings)
    found = components(_edges(rows))
    labelled = rows.join(found, "row_id", "left")
    market = c("origin_kind") == "marketplace"
    priority = F.when(market, 0).when(c("origin_kind") == "direct_post", 1).otherwise(2)
    order = F.struct(priority.alias("p"), c("published_at").isNull().alias("u"),
                     (-F.length(F.coalesce("description", F.lit("")))).alias("d"), c("source"), c("source_id"), c("row_id"))
    groups = labelled.filter(c("component").isNotNull()).groupBy("component").agg(
        F.min(order).alias("_best"), *_safety(F.when(market & c("publication_confirmed"), c("published_at")), market))
    return _merge(labelled, groups, c("_best.row_id"), _dates_differ())


def _parents(rows: DataFrame) -> DataFrame:
    """(row_id, parent) within each source: the first row with the same key, else the row before it with the same canonical URL.

    The row before is a lag over ranges of (source, URL, row): tasks get equal parts of the order however many rows share one URL, and
    the last row of each task is handed to the next one.
    """
    c = F.col
    keyed = rows.groupBy("source", "source_id").agg(F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    narrow = spread_join(rows.select("row_id", "source", "source_id", "canonical"), keyed, ["source", "source_id"], "_n", c("row_id"), "inner")
    order = ["source", "canonical", "row_id"]
    ranges = checkpoint(narrow.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order)
    ends = ranges.groupBy("_part").agg(F.max(F.struct(*order)).alias("_last"))
    carried = ends.withColumn("_before", F.lag("_last").over(Window.orderBy("_part"))).select("_part", "_before")  # one row per task
    same = F.struct("source", "canonical")
    before = F.coalesce(F.lag(F.struct(*order)).over(within), c("_before"))
    linked = ranges.join(F.broadcast(carried), "_part").withColumn("_prior", before)
    by_url = F.when(c("canonical").isNotNull() & (F.struct(c("_prior.source"), c("_prior.canonical")) == same), c("_prior.row_id"))
    parent = F.when(c("_first") < c("row_id"), c("_first")).otherwise(by_url)
    return linked.select("row_id", parent.alias("parent"))


def _roots(parents: DataFrame) -> DataFrame:
    """(row_id, root): follow parents to a row without one, doubling the step each round."""
    c = F.col
    chains = checkpoint(parents.select("row_id", F.coalesce("parent", "row_id").alias("root")))
    while True:
        above = chains.select(c("row_id").alias("root"), c("root").alias("_up"))
        longer = checkpoint(chains.join(above, "root").select("row_id", c("root").alias("_was"), c("_up").alias("root")))
        chains = longer.select("row_id", "root")
        if longer.filter("_was <> root").isEmpty():
            return chains


def exact_dedup(listings: DataFrame) -> DataFrame:
    """Within each source, in row order: a row repeats the first row with its key, or else the row before it with its canonical URL, and
    is merged into what that one was merged into. Rows which repeat none survive, with the safety merge of their repeats."""
    c = F.col
    rows = checkpoint(_identified(listings))
    labelled = rows.join(_roots(_parents(rows)).withColumnRenamed("root", "component"), "row_id")
    market = c("origin_kind") == "marketplace"
    groups = labelled.groupBy("component").agg(
        F.min(F.struct("row_id", "publication_confirmed")).alias("_first"),
        *_safety(F.when(market & c("publication_confirmed"), c("published_at")), market))
    return _merge(labelled, groups, c("component"), _dates_differ() & c("_first.publication_confirmed"))
