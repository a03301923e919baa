"""Rules and thresholds as one parameter object."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Mapping

from . import vocab


class ProfileError(ValueError):
    """A parameter lies outside its documented range."""


# parameter -> allowed range, both ends included
RANGES = {
    "max_age_hours": (1, 720),
    "min_score": (6, 10),
    "max_responses": (0, 10_000),
    "max_send": (1, 50),
    "history_limit": (100, 50_000),
}


@dataclass(frozen=True)
class Profile:
    """Lexicons, patterns and limits used by the operators.

    The defaults are the published rules. A profile with other lexicons runs the same jobs on any text table.
    """

    positive_terms: tuple[str, ...] = vocab.POSITIVE_TERMS
    negative_terms: tuple[str, ...] = vocab.NEGATIVE_TERMS
    term_patterns: Mapping[str, str] = field(default_factory=lambda: dict(vocab.TERM_PATTERNS))
    intent: str = vocab.IMPLEMENTATION_INTENT
    technical_category: str = vocab.TECHNICAL_CATEGORY
    software_product: str = vocab.SOFTWARE_PRODUCT
    manual_action: str = vocab.MANUAL_ACTION
    groups: tuple[tuple[str, ...], ...] = vocab.SPECIALIZATION_GROUPS
    stack_high: Mapping[str, str] = field(default_factory=lambda: dict(vocab.STACK_HIGH))
    stack_partial: Mapping[str, str] = field(default_factory=lambda: dict(vocab.STACK_PARTIAL))
    stack_low: Mapping[str, str] = field(default_factory=lambda: dict(vocab.STACK_LOW))
    post_advertisement: str = vocab.POST_ADVERTISEMENT
    post_education: str = vocab.POST_EDUCATION
    post_full_time: str = vocab.POST_FULL_TIME
    post_project_work: str = vocab.POST_PROJECT_WORK
    channels: tuple[str, ...] = vocab.DEFAULT_CHANNELS
    disabled_sources: tuple[str, ...] = vocab.SOURCES_OFF_BY_DEFAULT
    max_age_hours: int = 24
    hot_age_hours: int = 6
    min_score: int = 7
    max_responses: int = 20
    allow_stack_mismatch: bool = False
    max_send: int = 10
    history_limit: int = 10_000
    max_cards_per_page: int | None = None

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> "Profile":
        """Raise `ProfileError` for the first parameter out of range."""
        for name, (low, high) in RANGES.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
                raise ProfileError(f"{name}: expected {low}..{high}")
        if not isinstance(self.hot_age_hours, int) or not 1 <= self.hot_age_hours <= self.max_age_hours:
            raise ProfileError(f"hot_age_hours: expected 1..{self.max_age_hours}")
        if not isinstance(self.allow_stack_mismatch, bool):
            raise ProfileError("allow_stack_mismatch: expected true or false")
        names = tuple(dict.fromkeys(name.strip().lower() for name in self.channels if name.strip()))
        if not 1 <= len(names) <= 20 or not all(re.fullmatch(vocab.CHANNEL_NAME, name) for name in names):
            raise ProfileError("channels: expected 1..20 channel names")
        object.__setattr__(self, "channels", names)
        return self

    @property
    def age_limit(self) -> int:
        return min(24, self.max_age_hours)

    @property
    def hot_limit(self) -> int:
        return min(6, self.hot_age_hours, self.age_limit)

    @classmethod
    def from_conf(cls, conf: Mapping[str, str]) -> "Profile":
        """Build from string settings (`gigsift.<field>`), such as Spark configuration entries."""
        values: dict[str, object] = {}
        for f in fields(cls):
            raw = conf.get(f"gigsift.{f.name}")
            if raw is None:
                continue
            if f.type == "int":
                try:
                    values[f.name] = int(raw)
                except ValueError:
                    raise ProfileError(f"{f.name}: expected an integer") from None
            elif f.type == "bool":
                if raw.strip().lower() not in {"true", "false"}:
                    raise ProfileError(f"{f.name}: expected true or false")
                values[f.name] = raw.strip().lower() == "true"
            elif f.name in {"channels", "disabled_sources"}:
                values[f.name] = tuple(part.strip() for part in raw.split(",") if part.strip())
            else:
                raise ProfileError(f"{f.name}: not settable from text")
        return cls(**values)
