"""Scoring: points with reasons, hard gates, caps, eligibility and label. Pure column expressions."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.lexicon import contains_any, experience_required, named_columns, searchable, without_waivers
from ..functions.text import fixed_point, rx
from ..functions.values import age_hours, duration_days
from ..rules import Profile
from ..session import settled
from .classify import relevance, stack_compatibility
from .normalize import with_identity

ASSESSMENT = (
    "relevance_gate", "scored", "relevance_reason", "positive_keywords", "negative_keywords", "stack_compatibility",
    "stack_details", "stack_reason", "age_hours", "hot", "reasons", "raw_score", "score", "complexity", "risk_flags",
    "eligible", "label",
)


# assessed columns that rows may be filtered by, see `settled`
FILTERED = ("relevance_gate", "scored", "score", "risk_flags", "eligible", "label")


def moment(now: datetime | Column) -> Column:
    """The evaluation time as a column; rules never read the wall clock themselves."""
    if isinstance(now, Column):
        return now
    if now.tzinfo is None:
        raise ValueError("now must carry a time zone")
    return F.lit(now)


def steps(value: Column, *bounds: tuple[float, int], otherwise: int | None) -> Column:
    """Points of the first bound the value does not exceed."""
    result = F.when(value <= bounds[0][0], bounds[0][1])
    for limit, points in bounds[1:]:
        result = result.when(value <= limit, points)
    return result.otherwise(F.lit(otherwise)).cast("int")


def open_confirmed(status: Column, evidence: Column) -> Column:
    return (status == "open") & (F.trim(F.coalesce(evidence, F.lit(""))) != "")


def is_fresh(confirmed: Column, age: Column, limit: int) -> Column:
    return F.coalesce(confirmed & age.between(0, limit), F.lit(False))


def specialization_groups(positive: Column, groups) -> Column:
    """How many keyword groups the matched terms touch."""
    hit = lambda words: F.arrays_overlap(positive, F.array(*map(F.lit, words))).cast("int")
    return reduce(add, (hit(g) for g in groups))


def budget_rule(amount: Column, currency: Column) -> tuple[Column, Column, Column]:
    """(reason code, points, text) of the offered amount."""
    text = vocab.REASON_TEXT
    rub = F.coalesce(currency == "RUB", F.lit(False))
    pick = lambda none, foreign, low, small, target, above, large: (
        F.when(amount.isNull(), none).when(~rub, foreign).when(amount < 3000, low).when(amount < 5000, small)
        .when(amount <= 30000, target).when(amount <= 100000, above).otherwise(large))
    code = pick("unknown_budget", "foreign_budget", "budget_too_low", "budget", "budget", "budget", F.lit("budget"))
    points = pick(0, 0, 0, -2, 2, 1, F.lit(0))
    shown = pick(text["unknown_budget"], text["foreign_budget"], text["budget_too_low"], text["budget_small"],
                 text["budget_target"], text["budget_above"], F.lit(text["budget_large"]))
    return code, points.cast("int"), shown


def competition_points(responses: Column) -> Column:
    return F.when(responses.isNotNull(), steps(
        responses, (3, 3), (7, 2), (15, 1), (20, -1), (30, -3), otherwise=-5))


def freshness_points(age: Column) -> Column:
    return steps(age, (2, 3), (6, 2), (12, 1), otherwise=0)


def large_project_text(text: Column) -> Column:
    product, scratch = vocab.LARGE_PRODUCT, vocab.FROM_SCRATCH
    pattern = f"{product}.{{0,70}}{scratch}|{scratch}.{{0,70}}{product}|{vocab.LARGE_ROLLOUT}"
    return contains_any(text, ("нуля", "scratch", "enterprise", "внедрен")) & text.rlike(rx(pattern))


def _facts(listings: DataFrame, now: Column, profile: Profile) -> DataFrame:
    """Everything the points depend on, one column per fact."""
    c = F.col
    amount = F.coalesce("budget_max", "budget_min")
    texts = listings.withColumn("_text", searchable(F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))))
    closed = c("open_status").isin(*vocab.CLOSED_STATUSES)
    days = F.when(contains_any(c("_text"), ("дн", "день", "day")), duration_days(c("_text")))
    concrete = (F.length("description") >= vocab.CONCRETE_MIN_CHARS) & c("description").rlike(rx(vocab.CONCRETE_BRIEF))
    facts = texts.withColumn("_demands", without_waivers(c("_text"))).withColumns({
        "age_hours": age_hours(c("published_at"), now),
        "_mismatch": c("stack.level") == vocab.LOW_UNKNOWN_MATCH,
        "_skipped": c("discovery_skip_reason").isNotNull() | ~c("relevance.passed"),
        "_positive": c("relevance.matches.positive"),
        "_confirmed": F.coalesce(c("publication_confirmed"), F.lit(False)) & (F.coalesce("publication_evidence", F.lit("")) != ""),
        "_closed": closed,
        "_open": open_confirmed(c("open_status"), c("status_evidence")),
        "_amount": amount,
        "_foreign": ~F.coalesce(c("currency") == "RUB", F.lit(False)),
        "_concrete": F.coalesce(concrete, F.lit(False)),
        "_existing": c("_text").rlike(rx(vocab.EXISTING_PROJECT)),
        "_days": days,
        "_experience": experience_required(c("_text"), c("_demands")),
        "_large_text": large_project_text(c("_text"))})
    rub_amount = F.when(~c("_foreign"), c("_amount"))
    dated = facts.withColumns({
        "_fresh": c("age_hours").between(0, profile.age_limit),
        "_too_low": F.coalesce(rub_amount < 3000, F.lit(False)),
        "_large_budget": F.coalesce(rub_amount > 100000, F.lit(False)),
        "_large_late": F.coalesce(c("_large_text") | (c("_days") >= 30), F.lit(False))})
    return dated.withColumns({
        "_fresh": F.coalesce("_fresh", F.lit(False)),
        "_large": c("_large_budget") | c("_large_late"),
        "_status_unknown": c("open_status").isin("unknown", "open") & ~c("_open"),
        "_allowed": c("_confirmed") & c("direct_url").isNotNull() & ~c("_closed")
        & F.coalesce(c("_fresh"), F.lit(False)) & ~c("_too_low")})


def _points(facts: DataFrame, profile: Profile) -> DataFrame:
    c = F.col
    days = c("_days")
    _, budget, _ = budget_rule(c("_amount"), c("currency"))
    return facts.withColumns({
        "_p_groups": F.least(F.lit(4), specialization_groups(c("_positive"), profile.groups) + 1),
        "_p_fresh": F.when(c("_fresh"), freshness_points(c("age_hours"))),
        "_p_budget": budget,
        "_p_competition": competition_points(c("responses_count")),
        "_p_days": F.when(days.between(1, 5), 1).when((days > 10) & (days < 30), -2),
        "_long": F.coalesce((days > 10) & (days < 30), F.lit(False))})


def _reason(code: str | Column, points: int | Column, text: str | Column, when: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    row = F.struct(lit(code).alias("code"), lit(points).cast("int").alias("points"), lit(text).alias("text"))
    return row if when is None else F.when(when, row)


def _scored_reasons(profile: Profile) -> tuple[list[Column], list[Column]]:
    """(reasons with points, reasons of caps), both in their fixed order."""
    c, text = F.col, vocab.REASON_TEXT
    age, responses = c("age_hours"), c("responses_count")
    code, points, shown = budget_rule(c("_amount"), c("currency"))
    stack = F.concat(F.lit("STACK_COMPATIBILITY: "), c("stack.level"), F.lit("; "), c("stack.reason"))
    pointed = [
        _reason("base", 2, text["base"]),
        _reason("specialization", c("_p_groups"), c("relevance.reason")),
        _reason("stack_compatibility", c("stack.points"), stack),
        _reason("deep_1c", 0, text["deep_1c"], c("stack.deep_1c")),
        _reason("unconfirmed_publication", 0, text["unconfirmed_publication"], ~c("_confirmed")),
        _reason("invalid_direct_url", 0, text["invalid_direct_url"], c("direct_url").isNull()),
        _reason("closed_project", 0, text["closed_project"], c("_closed")),
        _reason("unknown_date", 0, text["unknown_date"], age.isNull()),
        _reason("future_date", 0, text["future_date"], age < 0),
        _reason("stale", 0, text["stale"] % profile.age_limit, age > profile.age_limit),
        _reason("fresh", c("_p_fresh"), F.format_string(text["fresh"], fixed_point(age, 1), c("_p_fresh")), c("_fresh")),
        _reason("concrete", 1, text["concrete"], c("_concrete")),
        _reason(code, points, shown),
        _reason("unknown_responses", 0, text["unknown_responses"], responses.isNull()),
        _reason("competition", c("_p_competition"), F.format_string(text["competition"], responses, c("_p_competition")),
                responses.isNotNull()),
        _reason("existing", 1, text["existing"], c("_existing")),
        _reason("short_task", 1, text["short_task"], c("_days").between(1, 5)),
        _reason("long_task", -2, text["long_task"], c("_long")),
        _reason("large_project", -3, text["large_project"], c("_large")),
        _reason("experience_gate", -3, text["experience_gate"], c("_experience")),
    ]
    crowded = F.when(responses > 30, F.lit(6)).otherwise(F.lit(7))
    caps = [
        _reason("hard_skip", 0, text["hard_skip"], ~c("_allowed")),
        _reason("fire_age_limit", 0, text["fire_age_limit"] % profile.hot_limit, c("_allowed") & (age > profile.hot_limit)),
        _reason("fire_blocked", 0, text["fire_blocked"], c("_large") | c("_experience")),
        _reason("competition_cap", 0, F.format_string(text["competition_cap"], crowded), responses.isNull() | (responses > 20)),
        _reason("partial_stack_cap", 0, text["partial_stack_cap"], c("stack.level") == vocab.PARTIAL_MATCH),
        _reason("open_status_cap", 0, text["open_status_cap"], c("_status_unknown")),
        _reason("deep_1c_cap", 0, text["deep_1c_cap"], c("stack.deep_1c")),
        _reason("stack_score_cap", 0, text["stack_score_cap"], c("_mismatch")),
    ]
    return pointed, caps


def _cap(profile: Profile) -> Column:
    c = F.col
    responses = c("responses_count")
    old = c("_allowed") & (c("age_hours") > profile.hot_limit)
    limits = (
        (~c("_allowed"), 5), (old | c("_large") | c("_experience"), 7), (responses.isNull() | (responses > 20), 7),
        (responses > 30, 6), ((c("stack.level") == vocab.PARTIAL_MATCH) | c("_status_unknown"), 7),
        (c("stack.deep_1c") | c("_mismatch"), 6),
    )
    return F.least(F.lit(10), *[F.when(condition, F.lit(limit)) for condition, limit in limits])


def _risk_flags(profile: Profile) -> Column:
    c = F.col
    old = c("_allowed") & (c("age_hours") > profile.hot_limit)
    flags = (
        ("STACK_MISMATCH", c("_mismatch")), ("DEEP_1C", c("stack.deep_1c")),
        ("UNCONFIRMED_PUBLICATION", ~c("_confirmed")), ("INVALID_DIRECT_URL", c("direct_url").isNull()),
        ("PROJECT_NOT_OPEN", c("_closed")), ("LARGE_PROJECT", c("_large_budget")),
        ("RESPONSES_UNKNOWN", c("responses_count").isNull()), ("HIGH_COMPETITION", c("responses_count") > 20),
        ("LARGE_PROJECT", c("_large_late") & ~c("_large_budget")), ("EXPERIENCE_GATE", c("_experience")),
        ("OPEN_STATUS_UNKNOWN", c("_status_unknown")), ("OLDER_THAN_HOT_WINDOW", old),
    )
    return named_columns(flags)


def score(classified: DataFrame, now: datetime | Column, profile: Profile = Profile(), fixed: tuple[str, ...] = FILTERED) -> DataFrame:
    """Score rows which already carry identity, `relevance` and `stack` columns. Those not `fixed` are computed only where they are used."""
    c = F.col
    pointed = _points(_facts(classified, moment(now), profile), profile)
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    yes = lambda name, points: F.when(c(name), F.lit(points)).otherwise(F.lit(0))
    raw = (F.lit(2) + c("_p_groups") + c("stack.points") + zero("_p_fresh") + yes("_concrete", 1) + c("_p_budget")
           + zero("_p_competition") + yes("_existing", 1) + zero("_p_days") + yes("_large", -3) + yes("_experience", -3))
    special = F.arrays_overlap("_positive", F.array(*map(F.lit, vocab.COMPLEXITY_TERMS)))
    effort = F.lit(3) + yes("_long", 2) + yes("_large", 3) + yes("_experience", 2) + F.when(special, 1).otherwise(0)
    effort = F.when(c("_mismatch") | c("stack.deep_1c"), F.greatest(effort, F.lit(6))).otherwise(effort)
    skip_code = F.coalesce(c("discovery_skip_reason"), c("relevance.code"))
    skip_text = c("relevance.reason")
    for reason, text in vocab.SKIP_TEXT.items():
        skip_text = F.when(c("discovery_skip_reason") == reason, text).otherwise(skip_text)
    with_points, caps = _scored_reasons(profile)
    none = F.array().cast("array<string>")
    mismatch_only = F.when(c("_mismatch"), F.array(F.lit("STACK_MISMATCH"))).otherwise(none)
    keywords = lambda name: F.when(c("discovery_skip_reason").isNull(), c(f"relevance.matches.{name}")).otherwise(none)
    live = lambda value, skipped: F.when(c("_skipped"), skipped).otherwise(value)
    first = pointed.withColumns({"_raw": raw, "_top": _cap(profile)})
    graded = first.withColumns({
        "relevance_gate": ~c("_skipped"), "scored": ~c("_skipped"),
        "relevance_reason": live(c("relevance.reason"), skip_text),
        "positive_keywords": keywords("positive"), "negative_keywords": keywords("negative"),
        "stack_compatibility": c("stack.level"), "stack_details": c("stack.matches"), "stack_reason": c("stack.reason"),
        "hot": live(F.coalesce(c("age_hours").between(0, profile.hot_limit), F.lit(False)), F.lit(False)),
        "reasons": live(F.array_compact(F.array(*with_points, *caps)), F.array(_reason(skip_code, 0, skip_text))),
        "raw_score": live(c("_raw"), F.lit(0)).cast("int"),
        "score": live(F.least(F.greatest(c("_raw"), F.lit(0)), c("_top")), F.lit(0)).cast("int"),
        "complexity": live(F.least(F.lit(10), effort), F.when(F.size("stack.unsupported") > 0, 6).otherwise(0)).cast("int"),
        "risk_flags": live(_risk_flags(profile), mismatch_only)})
    done = graded.withColumn("eligible", c("scored") & c("_allowed") & (c("score") >= 6))
    done = done.withColumn("label", F.when(~c("eligible"), "SKIP").when(c("score") >= 8, "FIRE").otherwise("GOOD"))
    done = done.drop(*[name for name in done.columns if name.startswith("_")], "relevance", "stack")
    return settled(done, *fixed)


def assess(listings: DataFrame, now: datetime | Column, profile: Profile = Profile(), fixed: tuple[str, ...] = FILTERED) -> DataFrame:
    """Valid listings -> listings with identity and assessment columns, one row each. Name in `fixed` the assessed columns that later
    filters use, see `settled`; of the others, those that nothing uses are not computed."""
    identified = listings if "fingerprint" in listings.columns else with_identity(listings, ())
    kept = identified.drop(*[name for name in (*ASSESSMENT, "delivery_blockers", "deliverable") if name in identified.columns])
    return score(stack_compatibility(relevance(kept, profile), profile), now, profile, fixed)
