"""Per-source metrics, source status, error codes, run summary, run events."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..rules import Profile
from .score import is_fresh, moment


def source_registry(spark: SparkSession, profile: Profile = Profile()) -> DataFrame:
    """(source, source_ord, enabled) in the fixed source order: one row per known source."""
    rows = [(name, i, name not in profile.disabled_sources) for i, name in enumerate(vocab.SOURCE_ORDER)]
    return spark.createDataFrame(rows, "source string, source_ord int, enabled boolean")


def listing_metrics(assessed: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Counters per source over assessed rows before deduplication."""
    fresh = is_fresh(F.col("publication_confirmed"), F.col("age_hours"), profile.age_limit)
    return assessed.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(fresh).alias("fresh_count"),
        F.count_if("relevance_gate").alias("relevant_count"), F.count_if("eligible").alias("eligible_count"))


def page_metrics(page_log: DataFrame) -> DataFrame:
    """Counters and the first error per source from a page log (source, seq, url, error, parse_errors, filtered_count)."""
    failed = F.col("error").isNotNull()
    return page_log.groupBy("source").agg(
        F.count_if(~failed).alias("pages_fetched"), F.count_if(failed).alias("failed_pages"),
        F.coalesce(F.sum("parse_errors"), F.lit(0)).alias("parse_errors"),
        F.coalesce(F.sum("filtered_count"), F.lit(0)).alias("filtered_count"),
        F.min_by("error", F.when(failed, F.col("seq"))).alias("first_error"))


def source_status(enabled: Column, pages: Column, failed: Column) -> Column:
    """disabled, error (nothing could be read), partial (something failed) or ok."""
    return (F.when(~enabled, "disabled").when((pages == 0) & (failed > 0), "error")
            .when(failed > 0, "partial").otherwise("ok"))


COUNTERS = ("fetched", "parse_errors", "filtered_count", "pages_fetched", "failed_pages", "details_fetched", "detail_failures",
            "fresh_count", "relevant_count", "eligible_count")


def source_metrics(registry: DataFrame, page_log: DataFrame, assessed: DataFrame, profile: Profile = Profile(),
                   detail_log: DataFrame | None = None) -> DataFrame:
    """One row per registered source, also for disabled ones."""
    joined = registry.join(page_metrics(page_log), "source", "left").join(listing_metrics(assessed, profile), "source", "left")
    if detail_log is not None:
        details = detail_log.groupBy("source").agg(
            F.count_if("fetched").alias("details_fetched"), F.count_if(F.col("error").isNotNull()).alias("detail_failures"),
            F.min_by("error", F.when(F.col("error").isNotNull(), F.col("rank"))).alias("_detail_error"))
        joined = joined.join(details, "source", "left")
    else:
        joined = joined.withColumns({"details_fetched": F.lit(0), "detail_failures": F.lit(0), "_detail_error": F.lit(None).cast("string")})
    filled = joined.withColumns({name: F.when(F.col("enabled"), F.coalesce(name, F.lit(0))).otherwise(0) for name in COUNTERS})
    status = source_status(F.col("enabled"), F.col("pages_fetched"), F.col("failed_pages"))
    status = F.when((status == "ok") & (F.col("detail_failures") > 0), "partial").otherwise(status)
    broken = F.col("enabled") & F.col("first_error").isin(*vocab.LAYOUT_ERROR_CODES)
    error = F.when(F.col("enabled"), F.coalesce("first_error", "_detail_error"))
    return filled.select(
        "source", "source_ord", status.alias("status"), error.alias("first_error"),
        *[F.when((F.lit(name) == "parse_errors") & broken, F.greatest(F.col(name), F.lit(1))).otherwise(F.col(name)).alias(name)
          for name in COUNTERS])


def page_errors(page_log: DataFrame) -> DataFrame:
    """(source, url, error): the failed pages as rows, however many one source has."""
    return page_log.filter(F.col("error").isNotNull()).select("source", "url", "error")


def error_counts(page_log: DataFrame) -> DataFrame:
    """(source, errors MAP<code, n>): the map holds the few fixed codes, never one entry per page."""
    counts = page_errors(page_log).groupBy("source", "error").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("errors"))


def run_summary(candidates: DataFrame, fetched: Column | int, profile: Profile = Profile()) -> DataFrame:
    """One row of counters over the deduplicated candidates; the filter counters may overlap."""
    c = F.col
    fresh = is_fresh(c("publication_confirmed"), c("age_hours"), profile.age_limit)
    blocked = lambda *codes: c("eligible") & F.arrays_overlap("delivery_blockers", F.array(*map(F.lit, codes)))
    counted = candidates.agg(
        F.count(F.lit(1)).alias("unique"), F.count_if(fresh).alias("fresh"), F.count_if("relevance_gate").alias("relevance_pass"),
        F.count_if("eligible").alias("eligible"), F.count_if(c("label") == "FIRE").alias("fire"),
        F.count_if(c("label") == "GOOD").alias("good"), F.count_if("deliverable").alias("deliverable"),
        F.count_if(blocked("COMPETITION", "COMPETITION_OVER_50", "RESPONSES_UNKNOWN")).alias("filtered_by_competition"),
        F.count_if(blocked("STACK_MISMATCH")).alias("filtered_by_stack"),
        F.count_if(c("eligible") & F.array_contains("risk_flags", "OPEN_STATUS_UNKNOWN")).alias("filtered_by_open_status"),
        F.count_if("already_seen").alias("duplicates"))
    total = fetched if isinstance(fetched, Column) else F.lit(fetched)
    return counted.withColumn("total_fetched", total.cast("bigint")).withColumn("discovery_duplicates", F.col("total_fetched") - F.col("unique"))


def full_summary(counted: DataFrame, per_source: DataFrame, checked_at: datetime | Column, sent: int = 0,
                 delivery_error: str | None = None) -> DataFrame:
    """The one row of `run_summary` with what was found and what failed per source; there is one entry per registered source."""
    c = F.col
    read = ~c("status").isin("disabled", "error")
    failed = c("status").isin("error", "partial")
    entry = lambda when, value: F.map_from_entries(F.transform(F.array_sort(F.collect_list(
        F.when(when, F.struct("source_ord", "source", value.alias("value"))))), lambda e: F.struct(e["source"], e["value"])))
    sources = per_source.agg(
        entry(read, c("fetched")).alias("source_counts"), entry(failed, c("first_error")).alias("source_error_codes"),
        F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("source_ord", "source")))), lambda e: e["source"]).alias("source_errors"),
        entry(F.lit(True), F.struct("status", *COUNTERS)).alias("source_metrics"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # one row each
    return one(counted).join(one(sources), "_one").drop("_one").withColumns({
        "sent": F.lit(sent), "delivery_error": F.lit(delivery_error).cast("string"), "checked_at": moment(checked_at)})


def run_events(metrics: DataFrame, at: datetime | Column) -> DataFrame:
    """(time, event, source, fields): one structured event per source, to be appended to the run log."""
    event = (F.when(F.col("status") == "error", "source_failed").when(F.col("status") == "partial", "source_partial")
             .when(F.col("status") == "ok", "source_ok").otherwise("source_disabled"))
    fields = F.to_json(F.struct(*[name for name in metrics.columns if name not in ("source", "source_ord")]))
    return metrics.select(moment(at).alias("time"), event.alias("event"), "source", fields.alias("fields"))
