"""Counts, budgets, dates, status labels and durations out of text. All inputs are cleaned text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import full, rx, squeeze

OFFSET_MICROS = vocab.LOCAL_OFFSET_HOURS * 3_600_000_000


def shift(moment: Column, micros: Column | int) -> Column:
    """Timestamp moved by a number of microseconds."""
    return F.timestamp_micros(F.unix_micros(moment) + micros)


def parse_count(text: Column) -> Column:
    digits = F.regexp_extract(text, full(r"([\d\s]+)(?:\s+[^\d]+)?"), 1)
    return F.regexp_replace(digits, r"(?U)\s", "").try_cast("int")


def parse_budget(text: Column) -> Column:
    """STRUCT<low, high, currency>; a field is NULL where the text does not say."""
    money = "decimal(38,2)"

    def read(text: Column) -> Column:
        currency = F.lit(None).cast("string")
        for pattern, code in reversed(vocab.CURRENCIES):
            currency = F.when(text.rlike(rx(pattern)), code).otherwise(currency)
        factor = F.when(text.rlike(rx(vocab.THOUSANDS_WORD)), F.lit(1000)).otherwise(F.lit(1))
        spelled = F.slice(F.regexp_extract_all(text, F.lit(rx(vocab.AMOUNT)), F.lit(0)), 1, 2)
        amounts = F.transform(spelled, lambda n: (F.replace(
            F.replace(F.regexp_replace(n, r"[ .](?=\d{3}(?:\D|$))", ""), F.lit(" "), F.lit("")),
            F.lit(","), F.lit(".")).try_cast("decimal(24,2)") * factor).cast(money))
        fixed = ~text.rlike(rx(vocab.NO_FIXED_PRICE)) & ~text.rlike(rx(vocab.PRICE_PER_TIME))
        return F.struct(F.when(fixed, currency).alias("currency"), amounts.alias("amounts"), text.rlike(rx(vocab.RANGE_MARK)).alias("range"),
                        text.rlike(rx(vocab.UPPER_BOUND)).alias("upper"), text.rlike(rx(vocab.LOWER_BOUND)).alias("lower"))

    def decide(facts: Column) -> Column:
        amounts = facts["amounts"]
        first, second = F.get(amounts, 0), F.get(amounts, 1)
        two = (F.size(amounts) == 2) & facts["range"]
        known = facts["currency"].isNotNull() & ~F.exists(amounts, lambda a: a.isNull())
        nothing = F.lit(None).cast(money)
        low = F.when(~known, nothing).when(two, F.least(first, second)).when(facts["upper"], nothing).otherwise(first)
        high = (F.when(~known, nothing).when(two, F.greatest(first, second)).when(facts["upper"], first).when(facts["lower"], nothing)
                .otherwise(first))
        return F.struct(low.alias("low"), high.alias("high"), facts["currency"].alias("currency"))

    # the optimizer copies a struct into every use of a field, but not a call: each pattern is then searched once
    return F.get(F.transform(F.transform(F.array(F.lower(text)), read), decide), 0)


def _wall_clock(text: Column) -> Column:
    """Micros of an ISO-like wall clock read as UTC, NULL if it is not a real date and time."""
    return F.unix_micros(text.try_cast("timestamp"))


def _iso(text: Column) -> Column:
    pattern = full(r"(\d{4}-\d{2}-\d{2})(?:[t ](\d{2}:\d{2})(:\d{2}(?:[.,]\d{1,6})?\d*)?(z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?", "i")
    group = lambda n: F.regexp_extract(text, pattern, n)
    clock = F.when(group(2) == "", F.lit("00:00")).otherwise(group(2))
    wall = _wall_clock(F.concat(group(1), F.lit(" "), clock, F.when(group(3) == "", F.lit(":00")).otherwise(F.translate(group(3), ",", "."))))
    zone = F.regexp_replace(group(4), "[:z]", "")
    field = lambda start: F.coalesce(F.substring(zone, start, 2).try_cast("bigint"), F.lit(0))
    seconds = (field(2) * 3600 + field(4) * 60 + field(6)) * F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(group(4) == "", F.lit(OFFSET_MICROS)).otherwise(seconds * 1_000_000)
    return F.when(group(1) != "", F.timestamp_micros(wall - offset))


def _dotted(text: Column) -> Column:
    pattern = full(r"(\d{1,2})\.(\d{1,2})\.(\d{4})(?:\s+(\d{1,2}):(\d{1,2}))?", "")
    two = lambda n: F.lpad(F.regexp_extract(text, pattern, n), 2, "0")
    wall = _wall_clock(F.concat(F.regexp_extract(text, pattern, 3), F.lit("-"), two(2), F.lit("-"), two(1),
                                F.lit(" "), two(4), F.lit(":"), two(5), F.lit(":00")))
    return F.when(text.rlike(pattern), F.timestamp_micros(wall - OFFSET_MICROS))


def _unit_seconds(unit: Column) -> Column:
    return (F.when(unit.startswith("секунд"), 1).when(unit.startswith("минут"), 60)
            .when(unit.startswith("час"), 3600).otherwise(86_400)).cast("bigint")


def parse_date(text: Column, now: Column) -> Column:
    """Moment named by ISO text, a dotted local date, a relative age or a day word; NULL if none fits."""
    text = F.lower(text)
    relative = full(vocab.RELATIVE_TIME)
    number = F.coalesce(F.regexp_extract(text, relative, 1).try_cast("bigint"), F.lit(1))
    ago = F.when(text.rlike(relative), shift(now, -number * _unit_seconds(F.regexp_extract(text, relative, 2)) * 1_000_000))
    words = full(vocab.DAY_WORDS)
    clock = F.regexp_extract(text, words, 2)
    hour, minute = F.substring_index(clock, ":", 1).try_cast("int"), F.substring_index(clock, ":", -1).try_cast("int")
    midnight = F.date_trunc("day", shift(now, OFFSET_MICROS))
    days = F.when(F.regexp_extract(text, words, 1) == "вчера", -86_400).otherwise(0)
    seconds = F.when(clock == "", F.lit(0)).when((hour < 24) & (minute < 60), hour * 3600 + minute * 60)
    named = F.when(text.rlike(words), shift(midnight, (days + seconds).cast("bigint") * 1_000_000 - OFFSET_MICROS))
    return F.coalesce(_iso(text), _dotted(text), F.when(text.isin(*vocab.NOW_WORDS), now), ago, named)


def parse_publication_time(text: Column, now: Column) -> Column:
    """As `parse_date`, but only for text which fixes the hour."""
    text = F.lower(text)
    precise = full(vocab.PRECISE_RELATIVE)
    spans = F.regexp_extract(text, precise, 1)
    numbers = F.regexp_extract_all(spans, F.lit(rx(vocab.PRECISE_PART)), F.lit(1))
    units = F.regexp_extract_all(spans, F.lit(rx(vocab.PRECISE_PART)), F.lit(2))
    seconds = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.try_cast("bigint") * _unit_seconds(u)),
                          F.lit(0).cast("bigint"), lambda total, s: total + s)
    has_clock = text.isin(*vocab.NOW_WORDS) | text.rlike(r"\d{1,2}:\d{2}")
    return (F.when(text.rlike(precise), shift(now, -seconds * 1_000_000))
            .when(text.rlike(rx(vocab.DAY_ROUNDED)), F.lit(None).cast("timestamp"))
            .when(has_clock, parse_date(text, now)))


def closed_status(label: Column) -> Column:
    """Status named by a label as a whole, NULL for any other text."""
    text = F.trim(F.translate(F.lower(label), "ё", "е"), F.lit(" .!:"))
    result = F.lit(None).cast("string")
    for pattern, status in reversed(vocab.STATUS_LABELS):
        result = F.when(text.rlike(full(pattern)), status).otherwise(result)
    return result


def age_hours(published_at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(published_at)) / F.lit(3_600_000_000.0)


def duration_days(text: Column) -> Column:
    pattern = rx(vocab.DURATION)
    upper = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    return F.coalesce(upper, F.regexp_extract(text, pattern, 1)).try_cast("bigint")


def post_skip_reason(text: Column, profile) -> Column:
    """Kind of a channel post which is not a one-off order, NULL for the rest."""
    full_time = text.rlike(rx(profile.post_full_time)) & ~text.rlike(rx(profile.post_project_work))
    return (F.when(text.rlike(rx(profile.post_advertisement)), "advertisement")
            .when(text.rlike(rx(profile.post_education)), "education")
            .when(full_time, "full_time_vacancy"))
