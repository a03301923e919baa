"""Record normalisation and validation: raw listings become valid rows and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import vocab
from ..functions.text import clean_or_null, clean_text, full, normalized_title
from ..functions.urls import canonical_url, fingerprint, safe_url, url_error, with_direct_card_url
from ..schema import MONEY, conform
from ..session import settled

MAX_MONEY = 1_000_000_000_000


def _is_text(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.StringType)


def _count(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(value, is wrong) of a counter column."""
    if name not in df.columns:
        return F.lit(None).cast("int"), F.lit(False)
    value = F.col(name).try_cast("int")
    return value, F.col(name).isNotNull() & (value.isNull() | (value < 0))


def _money(df: DataFrame, name: str) -> tuple[Column, Column]:
    if name not in df.columns:
        return F.lit(None).cast(MONEY), F.lit(False)
    wide = F.col(name).try_cast("decimal(38,2)")
    wrong = F.col(name).isNotNull() & (wide.isNull() | (wide < 0) | (wide > MAX_MONEY))
    return wide.try_cast(MONEY), wrong


def _instant(df: DataFrame, name: str) -> tuple[Column, Column]:
    """A text timestamp must carry its zone; a TIMESTAMP column already is an instant."""
    if name not in df.columns:
        return F.lit(None).cast("timestamp"), F.lit(False)
    if not _is_text(df, name):
        return F.col(name).cast("timestamp"), F.lit(False)
    zoned = F.col(name).rlike(r"(?i)(?:Z|[+-]\d{2}:?\d{2})\z")
    value = F.when(zoned, F.col(name).try_cast("timestamp"))
    return value, F.col(name).isNotNull() & value.isNull()


def validate(raw: DataFrame, description_limit: int | None = None, resolved: bool = False) -> DataFrame:
    """Normalise every field and add `errors`, the codes of all violated constraints in check order."""
    raw = _with_defaults(raw)
    published, no_zone = _instant(raw, "published_at")
    low, low_wrong = _money(raw, "budget_min")
    high, high_wrong = _money(raw, "budget_max")
    responses, responses_wrong = _count(raw, "responses_count")
    views, views_wrong = _count(raw, "views_count")
    confirmed = F.col("publication_confirmed").try_cast("boolean")
    source_id, title = clean_text(F.col("source_id"), 200, resolved), clean_text(F.col("title"), 500, resolved)
    cleaned = raw.select(
        *[F.col(c) for c in raw.columns if c not in NORMALIZED],
        "row_id", "source", source_id.alias("source_id"), title.alias("title"), F.col("url").alias("_url"),
        clean_or_null(F.col("description"), description_limit, resolved).alias("description"),
        clean_or_null(F.col("category"), 500, resolved).alias("category"),
        published.alias("published_at"), no_zone.alias("_no_zone"),
        low.alias("budget_min"), high.alias("budget_max"), (low_wrong | high_wrong).alias("_bad_budget"),
        F.upper("currency").alias("currency"), responses.alias("responses_count"), views.alias("views_count"),
        (responses_wrong | views_wrong).alias("_bad_count"), "channel", F.col("external_url").alias("_external_url"),
        "origin_kind", "discovery_skip_reason", confirmed.alias("publication_confirmed"),
        clean_or_null(F.col("publication_evidence"), 500, resolved).alias("publication_evidence"), "open_status",
        clean_or_null(F.col("status_evidence"), 500, resolved).alias("status_evidence"))
    refused = lambda column, *allowed: column.isNotNull() & ~column.isin(*allowed)
    checks = (
        ("invalid_source", ~F.coalesce(F.col("source").rlike(r"\A[a-z][a-z0-9_]{0,39}\z"), F.lit(False))),
        ("invalid_source_id", ~F.col("source_id").rlike(r"\A[A-Za-z0-9_-]{1,128}\z")),
        ("missing_title", F.col("title") == ""),
        ("invalid_url", url_error(F.col("_url")).isNotNull()),
        ("invalid_channel", F.col("channel").isNotNull() & ~F.col("channel").rlike(full(vocab.CHANNEL_NAME, ""))),
        ("invalid_url", F.col("_external_url").isNotNull() & url_error(F.col("_external_url")).isNotNull()),
        ("invalid_origin_kind", F.col("origin_kind").isNull() | refused(F.col("origin_kind"), *vocab.ORIGIN_KINDS)),
        ("invalid_discovery_skip_reason", refused(F.col("discovery_skip_reason"), *vocab.SKIP_REASONS)),
        ("invalid_publication_confirmation", F.col("publication_confirmed").isNull()),
        ("invalid_open_status", F.col("open_status").isNull() | refused(F.col("open_status"), *vocab.OPEN_STATUSES)),
        ("published_at_must_include_timezone", F.col("_no_zone")),
        ("invalid_budget", F.col("_bad_budget")),
        ("invalid_budget_range", F.coalesce(F.col("budget_min") > F.col("budget_max"), F.lit(False))),
        ("invalid_currency", F.col("currency").isNotNull() & ~F.col("currency").rlike(r"\A[A-Z]{3}\z")),
        ("invalid_count", F.col("_bad_count")),
    )
    errors = F.array_compact(F.array(*[F.when(wrong, F.lit(code)) for code, wrong in checks]))
    checked = cleaned.withColumn("errors", errors).withColumns({
        "url": safe_url(F.col("_url")), "external_url": safe_url(F.col("_external_url"))})
    return settled(checked.drop("_url", "_external_url", "_no_zone", "_bad_budget", "_bad_count"), "errors")


NORMALIZED = (
    "row_id", "source", "source_id", "title", "url", "description", "category", "published_at", "budget_min",
    "budget_max", "currency", "responses_count", "views_count", "channel", "external_url", "origin_kind",
    "discovery_skip_reason", "publication_confirmed", "publication_evidence", "open_status", "status_evidence",
)
_DEFAULTS = {"origin_kind": "marketplace", "publication_confirmed": "false", "open_status": "unknown"}


def _with_defaults(raw: DataFrame) -> DataFrame:
    """Absent columns get the record's default; NULL in a present column is judged by the checks."""
    missing = {c: F.lit(_DEFAULTS.get(c)).cast("string") for c in NORMALIZED
               if c not in raw.columns and c not in ("published_at", "budget_min", "budget_max", "responses_count", "views_count")}
    return raw.withColumns(missing) if missing else raw


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid listings, quarantined rows with their codes)."""
    valid = conform(checked.filter(F.size("errors") == 0).drop("errors"))
    return valid, checked.filter(F.size("errors") > 0).withColumn("error", F.col("errors")[0])


IDENTITY = ("key", "norm_title", "canonical", "direct_url", "fingerprint")


def with_identity(listings: DataFrame, fixed: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Add the derived identity columns: key, norm_title, canonical, direct_url, fingerprint. Those not `fixed`, see `settled`, are
    computed only where a query uses them."""
    c = F.col
    named = with_direct_card_url(listings.withColumns({
        "key": F.concat_ws(":", "source", "source_id"),
        "norm_title": normalized_title(c("title")),
        "canonical": canonical_url(c("url"))}))
    marked = named.withColumn("fingerprint", fingerprint(c("norm_title"), c("origin_kind"), c("url"), c("external_url")))
    return settled(marked, *fixed).select(*marked.columns)
