"""Delivery gate: every reason why an assessed listing must not be sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.lexicon import named_columns
from ..rules import Profile
from ..session import settled
from .score import open_confirmed


def delivery_blockers(profile: Profile, seen: Column) -> Column:
    c = F.col
    responses = c("responses_count")
    high = c("stack_compatibility") == vocab.HIGH_MATCH
    mismatch = (~c("stack_compatibility").isin(vocab.HIGH_MATCH, vocab.PARTIAL_MATCH)
                | F.array_contains("risk_flags", "STACK_MISMATCH"))
    lower_bound = F.coalesce("budget_min", "budget_max")
    generous = F.coalesce(high & ~mismatch & (c("currency") == "RUB") & (lower_bound >= 50_000), F.lit(False))
    fire = c("label") == "FIRE"
    gates = (
        ("INELIGIBLE", ~c("eligible")),
        ("MIN_SCORE", c("score") < profile.min_score),
        ("STACK_MISMATCH", mismatch & F.lit(not profile.allow_stack_mismatch)),
        ("RESPONSES_UNKNOWN", responses.isNull()),
        ("COMPETITION", responses > profile.max_responses),
        ("COMPETITION_OVER_50", (responses > 50) & ~generous),
        ("FIRE_REQUIRES_HIGH_MATCH", fire & (~high | mismatch)),
        ("OPEN_STATUS_UNCONFIRMED", fire & ~open_confirmed(c("open_status"), c("status_evidence"))),
        ("FIRE_COMPETITION", fire & (responses.isNull() | (responses > 20))),
        ("ALREADY_SEEN", seen),
    )
    return named_columns(gates)


GATED = ("delivery_blockers", "deliverable")


def apply_gate(assessed: DataFrame, profile: Profile = Profile(), seen: Column | None = None, fixed: tuple[str, ...] = GATED) -> DataFrame:
    """Add or replace `delivery_blockers` and `deliverable`. Those not `fixed`, see `settled`, are computed only where they are used."""
    flag = F.lit(False) if seen is None else F.coalesce(seen, F.lit(False))
    gated = assessed.withColumn("delivery_blockers", delivery_blockers(profile, flag))
    gated = gated.withColumn("deliverable", F.col("eligible") & (F.size("delivery_blockers") == 0))
    return settled(gated, *fixed)
