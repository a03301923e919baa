"""Outbox: what may be sent now, the sent prefix of a run, outcomes of sending."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..rules import Profile
from .deliver import apply_gate
from .render import with_messages
from .score import assess
from .views import candidate_order


def plan_outbox(candidates: DataFrame, now: datetime | Column, profile: Profile = Profile()) -> DataFrame:
    """Ranked rows to hand to the sender: gates are evaluated again with a later clock, messages are rendered before
    anything is reserved, and the number of rows is limited."""
    waiting = candidates.filter("deliverable AND NOT already_seen")
    checked = apply_gate(assess(waiting, now, profile), profile, F.col("already_seen")).filter("deliverable")
    rendered = with_messages(checked).filter("message_error IS NULL")
    best = rendered.orderBy(*candidate_order()).limit(profile.max_send)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*candidate_order())))  # no more than max_send rows


def send_prefix(attempts: DataFrame, group: str, cap: int) -> DataFrame:
    """Attempts (group, position, ok) which a run makes: it ends after the first failure or after `cap` successes.

    First failure and cap-th success are aggregates per group, so the attempts themselves are never windowed.
    """
    good = attempts.filter("ok")
    order = Window.partitionBy(group).orderBy("position")
    last_good = (good.select(group, "position").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap)
                 .groupBy(group).agg(F.max("position").alias("_p"), F.max("_n").alias("_n"))
                 .filter(F.col("_n") == cap).select(group, F.col("_p").alias("_full")))
    ends = attempts.groupBy(group).agg(
        F.min(F.when(~F.col("ok"), F.col("position"))).alias("_failed"), F.count(F.lit(1)).alias("_size")).join(last_good, group, "left")
    limit = F.least("_failed", "_full")
    from .skew import spread_join
    reached = spread_join(attempts, ends, [group], "_size", F.col("position"), "inner")
    return reached.filter(limit.isNull() | (F.col("position") <= limit)).select(*attempts.columns)


def retry_delay(value: Column, now: Column, fallback: Column) -> Column:
    """Seconds named by a Retry-After header: a number or an HTTP date, else the fallback."""
    date = F.regexp_extract(value, r"\A\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC|[+-]0000)\s*\z", 1)
    at = F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss"))
    seconds = (F.unix_micros(at) - F.unix_micros(now)) / 1_000_000
    # greatest() skips nulls, so each value is looked at only where there is one
    least = lambda number: F.when(number.isNotNull(), F.greatest(F.lit(0.0), number))
    return F.coalesce(least(value.try_cast("double")), least(seconds), fallback)


def classify_outcomes(outcomes: DataFrame, now: datetime | Column) -> DataFrame:
    """Add `outcome` (sent, retry, definite, uncertain) and `code` to sending attempts.

    Input: attempt (0-based), failure (NULL, connect, other), http_status, body, reply_bytes, read_seconds, retry_after.
    Only a definite failure may be sent again; doubt keeps the delivery pending.
    """
    from .score import moment
    c = F.col
    reply = F.from_json("body", "struct<ok:boolean,error_code:int,parameters:struct<retry_after:double>,result:struct<message_id:bigint>>")
    rows = outcomes.withColumn("_r", F.when(c("body").rlike(r"\A\s*\{"), reply))
    last = c("attempt") >= vocab.MAX_SEND_ATTEMPTS - 1
    fallback = F.pow(F.lit(2.0), c("attempt"))
    named = c("_r.parameters.retry_after").cast("string")
    delay = retry_delay(F.coalesce(named, c("retry_after")), moment(now), fallback)
    refused = F.coalesce(c("_r.ok") == F.lit(False), F.lit(False))
    limited = refused & ((c("http_status") == 429) | F.coalesce(c("_r.error_code") == 429, F.lit(False)))
    valid = F.try_parse_json("body").isNotNull() & c("_r").isNotNull()
    accepted = (c("http_status") == 200) & F.coalesce(c("_r.ok"), F.lit(False))
    code = (F.when(c("failure") == "connect", "telegram_connection_failed")
            .when(c("failure").isNotNull(), "telegram_delivery_uncertain")
            .when(c("reply_bytes") > vocab.MAX_REPLY_BYTES, "telegram_response_too_large")
            .when(c("read_seconds") > vocab.MAX_READ_SECONDS, "telegram_response_deadline")
            .when(~F.coalesce(valid, F.lit(False)), "telegram_invalid_response")
            .when(accepted & c("_r.result.message_id").isNotNull(), F.lit(None).cast("string"))
            .when(accepted, "telegram_missing_confirmation")
            .when(limited, "telegram_rate_limited")
            .when(refused & (c("http_status") < 500), "telegram_rejected")
            .otherwise("telegram_delivery_uncertain"))
    again = ~last & ((c("code") == "telegram_connection_failed")
                     | ((c("code") == "telegram_rate_limited") & (delay <= vocab.MAX_RETRY_SECONDS)))
    definite = c("code").isin("telegram_connection_failed", "telegram_rate_limited", "telegram_rejected", "telegram_failed")
    outcome = F.when(c("code").isNull(), "sent").when(again, "retry").when(definite, "definite").otherwise("uncertain")
    return rows.withColumn("code", code).withColumn("outcome", outcome).drop("_r")
