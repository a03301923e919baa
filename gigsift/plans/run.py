"""The two entry points: `check` evaluates without side effects, `run` also keeps state and an outbox."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..operators import dedup, deliver, history, metrics, outbox, score
from ..operators.normalize import split_valid, with_identity
from ..rules import Profile
from ..schema import DELIVERIES, HISTORY, conform
from ..session import checkpoint
from ..sources import detail, frontier, layouts


@dataclass(frozen=True)
class Result:
    """Tables of one evaluation. Nothing in it has been collected."""

    listings: DataFrame      # per-source distinct, valid, before cross-source deduplication
    quarantine: DataFrame    # cards which failed, with their code
    candidates: DataFrame    # survivors with assessment, `already_seen`, blockers
    page_log: DataFrame
    source_metrics: DataFrame
    summary: DataFrame       # one row: all counters, source counts, errors, time
    known: tuple[DataFrame, DataFrame]  # the history and deliveries it was checked against


def evaluate(listings: DataFrame, known: tuple[DataFrame, DataFrame], now: datetime, profile: Profile = Profile()) -> DataFrame:
    """Valid listings -> deduplicated, assessed and gated candidates."""
    survivors = dedup.deduplicate(listings)
    flagged = history.mark_seen(with_identity(survivors) if "fingerprint" not in survivors.columns else survivors, *known)
    return deliver.apply_gate(score.assess(flagged, now, profile), profile, F.col("already_seen"))


State = tuple[DataFrame, DataFrame]


def check(pages: DataFrame, now: datetime, profile: Profile = Profile(), known: State | Callable[[DataFrame], State] | None = None,
          detail_pages: DataFrame | None = None) -> Result:
    """Pages -> everything one run reports. Extracted cards are written once, since four results read them. `known` is the history and the
    deliveries, or a function that looks up those which listings may match."""
    spark = pages.sparkSession
    if not callable(known):
        known = known or (spark.createDataFrame([], HISTORY), spark.createDataFrame([], DELIVERIES))
        history.require_valid(*known)
    cards = checkpoint(layouts.extract_all(pages, now, profile))
    # nothing is read after a source's first restriction
    log = checkpoint(frontier.stop_after_restriction(layouts.page_log(cards)))
    reached = log.select("source", F.col("url").alias("page_url"), "seq")
    cards = checkpoint(cards.join(reached, ["source", "page_url", "seq"], "left_semi"))
    good = cards.filter("card_state = 'ok'")
    listings = dedup.exact_dedup(with_identity(conform(good).select(*[f for f in conform(good).columns if f not in CARD_COLUMNS])))
    detail_log = None
    if detail_pages is not None:
        listings = checkpoint(listings)
        restricted = log.filter(F.col("error").isin(*vocab.STOP_CODES)).select("source").distinct()
        picked = checkpoint(detail.detail_candidates(listings, now, profile).join(restricted, "source", "left_anti"))
        listings, detail_log = detail.confirm(listings, picked, detail_pages, now)
    listings = checkpoint(listings)
    if callable(known):
        known = known(listings)
        history.require_valid(known[0], known[1].limit(0))
    registry = metrics.source_registry(spark, profile)
    assessed = score.assess(listings, now, profile)
    per_source = metrics.source_metrics(registry, log, assessed, profile, detail_log)
    candidates = checkpoint(evaluate(listings, known, now, profile))
    per_source = checkpoint(per_source)
    summary = checkpoint(metrics.full_summary(metrics.run_summary(candidates, listings.count(), profile), per_source, now))
    quarantine = cards.filter("card_state = 'invalid'").select("source", "page_url", "card_ord", F.col("card_error").alias("error"))
    return Result(listings, quarantine, candidates, log, per_source, summary, known)


CARD_COLUMNS = ("page_url", "page_no", "seq", "page_error", "cards_cut", "card_ord", "card_state", "card_error")


def plan_delivery(result: Result, state: tuple[DataFrame, DataFrame], now: datetime, later: datetime, profile: Profile = Profile()
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outbox, history, deliveries): observe everything found, then reserve what may be sent, in rank order; a listing which a reservation
    before it has made a duplicate is left out of the outbox."""
    observed = checkpoint(history.observe(result.listings, state[0], now))
    box = checkpoint(outbox.plan_outbox(result.candidates, later, profile))
    records, entries, taken = history.reserve(observed, state[1], box, later, profile)
    return taken, records, entries


def reconcile(state: tuple[DataFrame, DataFrame], sent: DataFrame | None, attempts: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(history, deliveries) after the sender's `attempts` (key and the columns of `classify_outcomes`) on outbox rows `sent`. Attempts on
    deliveries which are settled already change nothing, so a log may be read again from its start."""
    outcomes = outbox.classify_outcomes(attempts, now).filter("outcome <> 'retry'").select("key", "outcome")
    return history.settle(*state, sent, outcomes, now)


def ingest_listings(raw: DataFrame, description_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) listings of a raw listing table."""
    from ..operators.normalize import validate
    return split_valid(validate(raw, description_limit))
