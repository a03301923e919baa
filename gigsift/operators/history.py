"""Permanent history: matching, observation, delivery state, retention, validation, snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import vocab
from ..functions.urls import canonical_url, url_error
from ..rules import Profile
from ..schema import DELIVERIES, HISTORY
from ..session import checkpoint
from .precedence import KEYS, first_come
from .score import moment
from .skew import matched_groups, spread_join
from .views import ranked


class StateError(RuntimeError):
    """History cannot be trusted; nothing may be sent."""


def _pairs(*columns: tuple[str, Column]) -> Column:
    rows = [F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value"))) for kind, value in columns]
    return F.array_distinct(F.array_compact(F.array(*rows)))


def listing_identities(listings: DataFrame, by: str = "row_id") -> DataFrame:
    """(row_id, kind, value) a listing is looked up with; `by` names the column that tells rows apart. Needs the identity columns."""
    c = F.col
    pairs = _pairs(("fingerprint", c("fingerprint")), ("key", c("key")), ("url", c("canonical")), ("url", c("_direct")))
    rows = listings.withColumn("_direct", canonical_url(c("direct_url")))
    return rows.select(by, F.explode(pairs).alias("i")).select(by, "i.kind", "i.value")


def history_identities(history: DataFrame, *carried: str) -> DataFrame:
    """(kind, value, ...) a history record is found by."""
    c = F.col
    pairs = _pairs(("fingerprint", c("fingerprint")), ("key", F.concat_ws(":", "source", "source_id")), ("url", c("normalized_url")))
    return history.select(F.explode(pairs).alias("i"), *carried).select("i.kind", "i.value", *carried)


def _flag_matches(listings: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, known, blocking) of listings with at least one identity in `known`(kind, value, blocking)."""
    probes = listing_identities(listings)
    groups = matched_groups(probes, known, KEYS)
    hits = spread_join(probes, groups, KEYS, "_n", F.col("row_id"), "inner")
    return hits.groupBy("row_id").agg(F.lit(True).alias("known"), F.bool_or("blocking").alias("blocking"))


def known_identities(history: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row per identity; `blocking` where a pending or sent record stands behind it."""
    delivered = deliveries.select(F.lit("key").alias("kind"), F.col("key").alias("value"), F.lit("sent").alias("status"))
    rows = history_identities(history, "status").unionByName(delivered)
    return rows.groupBy(*KEYS).agg(F.bool_or(F.col("status").isin("pending", "sent")).alias("blocking"))


def mark_seen(listings: DataFrame, history: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Add `already_seen`: a delivery exists or an identity is already pending or sent."""
    flags = _flag_matches(listings, known_identities(history, deliveries)).select("row_id", "blocking")
    return (listings.join(flags, "row_id", "left")
            .withColumn("already_seen", F.coalesce("blocking", F.lit(False))).drop("blocking"))


def as_record(listings: DataFrame, now: Column) -> DataFrame:
    """History record of a listing seen for the first time."""
    c = F.col
    return listings.select(
        "row_id", "fingerprint", "source", "source_id", canonical_url(F.coalesce("direct_url", "url")).alias("normalized_url"),
        now.alias("first_seen_at"), F.lit(None).cast("timestamp").alias("sent_at"), F.lit("seen").alias("status"))


def new_records(listings: DataFrame, history: DataFrame, now: datetime | Column, on_round=None) -> DataFrame:
    """Records to add: listings, in row order, which match neither history nor a record added before them."""
    c = F.col
    known = history_identities(history).distinct().withColumn("blocking", F.lit(False))
    fresh = checkpoint(listings.join(_flag_matches(listings, known).select("row_id"), "row_id", "left_anti"))
    offers = _pairs(("fingerprint", c("fingerprint")), ("key", c("key")), ("url", F.coalesce(canonical_url(c("direct_url")), c("canonical"))))
    offered = fresh.select("row_id", F.explode(offers).alias("i")).select("row_id", "i.kind", "i.value")
    added = first_come(listing_identities(fresh), offered, on_round)
    return as_record(fresh.join(added, "row_id", "left_semi"), moment(now)).drop("row_id")


def observe(listings: DataFrame, history: DataFrame, now: datetime | Column) -> DataFrame:
    """History with the first observation of every new listing."""
    return history.unionByName(new_records(listings, history, now))


# --- delivery state --------------------------------------------------------------------------------------------------


def _claims(history: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, kind, value) of picked listings, and (key, blocked, record) of those which match a record: whether one of them is pending or
    sent, and the fingerprint of the earliest. Each identity is summed up first, so that a listing meets as many rows as it has identities,
    however many records share one of them."""
    c = F.col
    probes = checkpoint(listing_identities(picked, "key").distinct())
    known = history_identities(history, "fingerprint", "first_seen_at", "status").groupBy(*KEYS).agg(
        F.bool_or(c("status").isin("pending", "sent")).alias("_blocked"), F.min(F.struct("first_seen_at", "fingerprint")).alias("_first"))
    met = spread_join(probes, matched_groups(probes, known, KEYS), KEYS, "_n", c("key"), "inner")
    return probes, met.groupBy("key").agg(F.bool_or("_blocked").alias("blocked"), F.min("_first")["fingerprint"].alias("record"))


def reserve(history: DataFrame, deliveries: DataFrame, picked: DataFrame, now: datetime | Column,
            profile: Profile = Profile()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, deliveries, taken): each listing of `picked`, in the order of its column `rank` if there is one, else of row_id, claims the
    earliest record it matches, which turns pending and keeps its `first_seen_at`. A listing is not taken if it has a delivery, or if a record
    it matches is pending or sent, be it by a claim of a listing before it; so no record is claimed twice."""
    c, at = F.col, moment(now)
    order = "rank" if "rank" in picked.columns else "row_id"
    first = F.min(F.struct(order, "row_id")).alias("_first")
    wanted = checkpoint(picked.join(picked.groupBy("key").agg(first), "key").filter(F.struct(order, "row_id") == c("_first")).drop("_first")
                        .join(deliveries.select("key"), "key", "left_anti"))
    known = checkpoint(observe(wanted, history, now))
    probes, met = _claims(known, wanted)
    claims = met.filter("NOT coalesce(blocked, false)").select("key", "record")
    numbered = checkpoint(ranked(claims.join(wanted.select("key", order, F.col("row_id").alias("_row")), "key"), [c(order), c("_row")])
                          .withColumn("row_id", c("rank").cast("bigint")).select("key", "row_id", "record"))
    # a record found by its key alone gets another key when it is claimed, and is no obstacle then
    asked = probes.filter("kind <> 'key'").join(numbered.select("key", "row_id"), "key").select("row_id", *KEYS)
    claimable = known.join(numbered.select(c("record").alias("fingerprint")).distinct(), "fingerprint", "left_semi")
    offered = history_identities(claimable, "fingerprint").filter("kind <> 'key'").join(
        numbered.select(c("record").alias("fingerprint"), "row_id"), "fingerprint").select("row_id", *KEYS)
    winners = checkpoint(numbered.join(first_come(asked, offered), "row_id"))
    owner = winners.groupBy("record").agg(F.min("row_id").alias("row_id")).join(winners, ["record", "row_id"])
    claimed = known.join(owner.select(c("record").alias("fingerprint"), "key").join(wanted.select(
        "key", c("source").alias("_source"), c("source_id").alias("_source_id")), "key").drop("key"), "fingerprint", "left").withColumns({
            "status": F.when(c("_source").isNotNull(), "pending").otherwise(c("status")),
            "source": F.coalesce("_source", "source"), "source_id": F.coalesce("_source_id", "source_id")}).select(*HISTORY.fieldNames())
    taken = checkpoint(wanted.join(owner.select("key"), "key", "left_semi"))
    kept = retain(deliveries, profile.history_limit, taken.count())
    assessment = F.to_json(F.struct(*[name for name in ("score", "label", "stack_compatibility", "stack_reason", "risk_flags", "reasons")
                                      if name in picked.columns]))
    rows = taken.select("key", "source", "source_id", F.lit("pending").alias("status"), at.alias("reserved_at"),
                        F.lit(None).cast("timestamp").alias("sent_at"), assessment.alias("assessment"))
    return checkpoint(claimed), checkpoint(kept.unionByName(rows)), taken


OUTCOME_ORDER = ("definite", "uncertain", "sent")  # the last one that occurs for a key holds


def settle(history: DataFrame, deliveries: DataFrame, picked: DataFrame | None, outcomes: DataFrame, now: datetime | Column
           ) -> tuple[DataFrame, DataFrame]:
    """Apply all `outcomes`(key, outcome) to pending deliveries: a sent one is kept with its time, a definite failure is released, an
    uncertain one stays pending. Of several outcomes of a key, sent goes before uncertain before definite. `picked` has the identities of
    the deliveries, one row each; those it lacks are found by their key."""
    c, at = F.col, moment(now)
    place = F.array_position(F.array(*map(F.lit, OUTCOME_ORDER)), c("outcome"))
    pending = deliveries.filter("status = 'pending'").select("key")
    final = checkpoint(outcomes.filter(place > 0).groupBy("key").agg(F.max_by("outcome", place).alias("outcome"))
                       .filter("outcome <> 'uncertain'").join(pending, "key", "left_semi"))
    touched = history.select(F.concat_ws(":", "source", "source_id").alias("key"), "fingerprint").join(final, "key").select("fingerprint", "outcome")
    if picked is not None:
        known = picked.join(final, "key", "left_semi").dropDuplicates(["key"])
        # outcomes meet records by identity, each summed up first: no pairs of listings and records
        told = (listing_identities(known, "key").join(final, "key").groupBy(*KEYS).agg(F.max("outcome").alias("outcome")))
        records = history_identities(history, "fingerprint")
        found = spread_join(records, matched_groups(records, told, KEYS), KEYS, "_n", c("fingerprint"), "inner")
        touched = found.select("fingerprint", "outcome").union(touched)
    verdict = checkpoint(touched.groupBy("fingerprint").agg(F.max("outcome").alias("_outcome")))
    updated = (history.join(verdict, "fingerprint", "left")
               .withColumn("_sent", F.coalesce(c("_outcome") == "sent", F.lit(False)))
               .withColumns({"sent_at": F.when(c("_sent"), at).otherwise(c("sent_at")),
                             "status": F.when(c("_sent"), "sent").when(
                                 (c("_outcome") == "definite") & (c("status") == "pending"), "seen").otherwise(c("status"))})
               .select(*HISTORY.fieldNames()))
    entries = (deliveries.join(final, "key", "left").filter("outcome IS NULL OR outcome = 'sent'")
               .withColumns({"status": F.coalesce(c("outcome"), c("status")),
                             "sent_at": F.when(c("outcome") == "sent", F.coalesce("sent_at", at)).otherwise(c("sent_at"))})
               .select(*DELIVERIES.fieldNames()))
    return checkpoint(updated), checkpoint(entries)


def retain(deliveries: DataFrame, limit: int, adding: int = 1) -> DataFrame:
    """Drop the oldest sent deliveries so that `adding` more stay within the limit. Pending ones are never dropped."""
    total, sent = deliveries.agg(F.count(F.lit(1)), F.count_if(F.col("status") == "sent")).first()
    excess = total + adding - limit
    if excess <= 0:
        return deliveries
    if sent < excess:
        raise StateError("too many pending deliveries: reconcile uncertain sends first")
    return deliveries.filter(~((F.col("status") == "sent") & _among_oldest(deliveries.filter("status = 'sent'"), excess)))


FAN = 1024  # ranges of time counted per pass


def _among_oldest(sent: DataFrame, n: int) -> Column:
    """Whether a row is one of the `n` first of `sent` by sent_at and key: counting passes narrow down the time of the n-th row, then, among
    rows of that time, its key, sign by sign. A pass returns as many counts as there are ranges or signs; nothing is sorted."""
    c = F.col
    at = F.coalesce(F.unix_micros(F.col("sent_at").cast("timestamp")), F.lit(-(1 << 60)))
    slim = checkpoint(sent.select(at.alias("at"), "key"))

    def narrowed(rows: DataFrame, by: Column, left: int) -> tuple:
        """(value of `by` in which row `left` lies, how many of its rows are wanted, how many it has)."""
        for value, count in sorted((row["by"], row["n"]) for row in rows.groupBy(by.alias("by")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if left <= count:
                return value, left, count
            left -= count

    low, high = slim.agg(F.min("at"), F.max("at")).first()
    left = n
    while low < high:
        width = (high - low) // FAN + 1
        part, left, _ = narrowed(slim.filter(c("at").between(low, high)), F.expr(f"(at - {low}L) div {width}L"), left)
        low, high = low + part * width, min(high, low + (part + 1) * width - 1)
    ties, prefix = slim.filter(c("at") == low), ""
    whole = ties.count()
    while left < whole:
        sign, left, whole = narrowed(ties.filter(c("key").startswith(prefix)), F.substring("key", len(prefix) + 1, 1), left)
        if not sign:  # the key ends here
            return (at < low) | ((at == low) & (c("key") <= prefix))
        prefix += sign
    return (at < low) | ((at == low) & ((c("key") < prefix) | c("key").startswith(prefix)))


def log_stretches(log: DataFrame) -> DataFrame:
    """The log dealt by ranges of (key, ts, seq), with the number of its range as `_stretch`: a busy key is cut into many."""
    return log.repartitionByRange("key", "ts", "seq").withColumn("_stretch", F.spark_partition_id())


def fold_state(log: DataFrame) -> DataFrame:
    """Final state per key of an action log (key, ts, seq, action: observe, reserve, sent, release).

    A stretch of a key's log is a function of whether the key is reserved at its start. Each stretch is summed to that function (first
    observation, first delivery if reserved before, first delivery in any case, whether reserved at the end); the functions of a key, one
    row per stretch, are composed in order. No task sorts more of a key than a range holds.
    """
    c = F.col
    open_ = F.when(c("action") == "reserve", True).when(c("action") == "release", False)
    rows = log_stretches(log.select("key", "ts", "seq", "action")).withColumn("_open", open_)
    inside = Window.partitionBy("key", "_stretch").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.withColumn("_was_open", F.last("_open", ignorenulls=True).over(inside))
    sent = c("action") == "sent"
    functions = scanned.groupBy("key", "_stretch").agg(
        F.min(F.when(c("action").isin("observe", "reserve"), c("ts"))).alias("first_seen_at"),
        F.min(F.when(sent & c("_was_open"), c("ts"))).alias("_sent"),
        F.min(F.when(sent & c("_was_open").isNull(), c("ts"))).alias("_sent_if_open"),
        F.max_by("_open", F.when(c("_open").isNotNull(), F.struct("ts", "seq"))).alias("_end"))
    earlier = Window.partitionBy("key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = functions.withColumn("_begin", F.last("_end", ignorenulls=True).over(earlier))
    final = begun.groupBy("key").agg(
        F.min("first_seen_at").alias("first_seen_at"),
        F.min(F.least("_sent", F.when(c("_begin"), c("_sent_if_open")))).alias("sent_at"),
        F.max_by("_end", F.when(c("_end").isNotNull(), c("_stretch"))).alias("_open"))
    status = F.when(c("sent_at").isNotNull(), "sent").when(c("_open"), "pending").otherwise("seen")
    return final.filter(c("first_seen_at").isNotNull()).select("key", status.alias("status"), "first_seen_at", "sent_at")


# --- reading and writing state --------------------------------------------------------------------------------


def history_problems(history: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(rule, n): how many rows violate each rule of the state contract."""
    c = F.col
    bad = lambda wrong: F.count_if(F.coalesce(wrong, F.lit(True)))
    records = history.agg(
        bad(~c("fingerprint").rlike(r"\A[a-f0-9]{64}\z")).alias("invalid_fingerprint"),
        bad(~c("source").rlike(r"\A[a-z][a-z0-9_]{0,39}\z") | ~c("source_id").rlike(r"\A[A-Za-z0-9_-]{1,128}\z")).alias("invalid_history_identity"),
        bad(~c("status").isin(*vocab.STATE_STATUSES)).alias("invalid_history_status"),
        bad(c("first_seen_at").isNull()).alias("invalid_history_timestamp"),
        bad((c("status") == "sent") & c("sent_at").isNull()).alias("invalid_sent_timestamp"),
        bad((c("status") != "sent") & c("sent_at").isNotNull()).alias("unexpected_sent_timestamp"),
        bad(c("normalized_url").isNotNull() & (url_error(c("normalized_url")).isNotNull()
            | (F.coalesce(canonical_url(c("normalized_url")), F.lit("")) != c("normalized_url")))).alias("invalid_history_url"))
    entries = deliveries.agg(
        bad(c("key") != F.concat_ws(":", "source", "source_id")).alias("invalid_state_entry"),
        bad(~c("status").isin("pending", "sent")).alias("invalid_state_status"),
        bad(F.when(c("status") == "sent", c("sent_at")).otherwise(c("reserved_at")).isNull()).alias("invalid_state_timestamp"))
    backed = history.select(F.concat_ws(":", "source", "source_id").alias("key"), "status", F.col("sent_at").alias("_at"))
    lonely = deliveries.join(backed, (deliveries["key"] == backed["key"]) & (deliveries["status"] == backed["status"])
                             & deliveries["sent_at"].eqNullSafe(backed["_at"]), "left_anti")
    orphans = lonely.agg(F.count(F.lit(1)).alias("inconsistent_delivery_history"))
    repeated = lambda df, key, rule: df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(c("_n") > 1).alias(rule))
    doubles = (repeated(history, "fingerprint", "duplicate_fingerprint"), repeated(deliveries, "key", "duplicate_delivery"))
    tall = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c(n).alias("n")) for n in df.columns])).alias("r")).select("r.rule", "r.n")
    return tall(records).union(tall(entries)).union(tall(orphans)).union(tall(doubles[0])).union(tall(doubles[1]))


def require_valid(history: DataFrame, deliveries: DataFrame) -> None:
    """Fail closed: starting from a damaged history would repeat every message."""
    broken = history_problems(history, deliveries).filter("n > 0").orderBy("rule").first()
    if broken is not None:
        raise StateError(f"state is invalid ({broken['rule']}): restore it before sending")


def migrate_deliveries(deliveries: DataFrame) -> DataFrame:
    """History records for version-1 state, which held deliveries only."""
    c = F.col
    url = F.lit(None).cast("string")
    for source, prefix in vocab.LEGACY_URL_PREFIXES.items():
        url = F.when(c("source") == source, F.concat(F.lit(prefix), c("source_id"))).otherwise(url)
    return deliveries.select(
        F.sha2(F.concat(F.lit("legacy:"), c("key")), 256).alias("fingerprint"), "source", "source_id",
        F.when(c("source_id").rlike(r"\A\d+\z"), url).alias("normalized_url"),
        F.coalesce("reserved_at", "sent_at").alias("first_seen_at"), "sent_at", "status")


def read_json_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(history, deliveries) from an exported JSON state document of version 1 or 2; refuses anything else."""
    entry = "struct<source:string,source_id:string,status:string,reserved_at:string,sent_at:string,assessment:string>"
    record = "struct<source:string,source_id:string,normalized_url:string,first_seen_at:string,sent_at:string,status:string>"
    schema = f"version int, entries map<string,{entry}>, fingerprints map<string,{record}>, _corrupt string"
    c = F.col
    document = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    head = document.agg(
        F.count(F.lit(1)).alias("n"), F.max("version").alias("version"), F.count_if(c("_corrupt").isNotNull()).alias("corrupt"),
        F.count_if(c("entries").isNull()).alias("no_entries"), F.count_if(c("fingerprints").isNull()).alias("no_history")).first()
    if head["n"] != 1 or head["corrupt"] or head["no_entries"] or head["version"] not in (1, 2):
        raise StateError("state is unreadable (invalid_state_schema): restore it before sending")
    if head["version"] == 2 and head["no_history"]:
        raise StateError("state is unreadable (missing_fingerprint_history): restore it before sending")
    zoned = lambda name: F.when(c(name).rlike(r"(?:[Zz]|[+-]\d{2}:\d{2})\z"), c(name).try_cast("timestamp"))
    raw = document.select(F.explode("entries").alias("key", "e")).select("key", "e.*")
    odd = raw.filter((c("reserved_at").isNotNull() & zoned("reserved_at").isNull()) | (c("sent_at").isNotNull() & zoned("sent_at").isNull()))
    deliveries = raw.withColumns({"reserved_at": zoned("reserved_at"), "sent_at": zoned("sent_at")}).select(*DELIVERIES.fieldNames())
    if head["version"] == 1:
        history = migrate_deliveries(deliveries)
    else:
        told = document.select(F.explode("fingerprints").alias("fingerprint", "h")).select("fingerprint", "h.*")
        odd = odd.select("key").union(told.filter(c("sent_at").isNotNull() & zoned("sent_at").isNull()).select("fingerprint"))
        history = told.withColumns({"first_seen_at": zoned("first_seen_at"), "sent_at": zoned("sent_at")}).select(*HISTORY.fieldNames())
    if not odd.isEmpty():
        raise StateError("state is unreadable (invalid_state_timestamp): restore it before sending")
    require_valid(history, deliveries)
    return history, deliveries


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Do two state tables hold the same rows? Then no new version is written."""
    columns = [F.col(name) for name in left.columns]
    signature = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")),
                                  F.sum(F.hash(*columns).cast("bigint"))).first()
    return signature(left) == signature(right)
