"""Text columns: cleaning, regex helpers, redaction, display."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .. import vocab

WORD = r"[\p{L}\p{N}_]"
# Characters which unescaping, NFKC and the control-character rule all leave alone. Rows made only of these never
# leave the JVM: ASCII without '&', Latin-1 letters, Cyrillic, common dashes and quotes, a few signs.
STABLE = r"\x20-\x25\x27-\x7e\n\t¡§©«®°·»¿-ÿЀ-џ–—‘-„€₽"


def rx(pattern: str, flags: str = "iUd") -> str:
    """Java form of a pattern: Unicode classes and case folding, `.` stops only at newline, word = letter/number/_."""
    return f"(?{flags})" + pattern.replace(r"\w", WORD)


def full(pattern: str, flags: str = "iUd") -> str:
    """Pattern for a whole-string match (`rlike` is a search)."""
    return rx(rf"\A(?:{pattern})\z", flags)


def bounded(pattern: str) -> str:
    """Pattern not preceded or followed by a word character."""
    return rx(rf"(?<!\w)(?:{pattern})(?!\w)")


@F.pandas_udf(T.StringType())
def _compatible_form(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", html.unescape(v)))


def unescaped(value: Column) -> Column:
    """HTML entities resolved and NFKC applied; Python sees only the rows which need it."""
    unstable = value.rlike(f"[^{STABLE}]")
    return F.coalesce(_compatible_form(F.when(unstable, value)), value)


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def clean_text(value: Column, limit: int | None = None, resolved: bool = False) -> Column:
    """Unescape, NFKC, drop control and format characters, collapse whitespace, cut. NULL becomes ''.

    `resolved` says that entities and NFKC were applied before, as they are in text taken from a page.
    """
    visible = F.regexp_replace(value if resolved else unescaped(value), r"[\p{C}&&[^\n\t]]", "")
    text = F.coalesce(squeeze(visible), F.lit(""))
    return text if limit is None else F.substring(text, 1, limit)


def clean_or_null(value: Column, limit: int | None = None, resolved: bool = False) -> Column:
    return F.nullif(clean_text(value, limit, resolved), F.lit(""))


def casefold(value: Column) -> Column:
    """Lower case with the expansions that matter after NFKC (sharp s, final sigma)."""
    return F.replace(F.translate(F.lower(value), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def normalized_title(cleaned: Column) -> Column:
    """Comparable form of an already cleaned title."""
    return F.trim(F.regexp_replace(F.translate(casefold(cleaned), "ё", "е"), r"[^\p{L}\p{N}_]+", " "))


def long_title(normalized: Column) -> Column:
    """Titles specific enough to identify a listing."""
    return (F.length(normalized) >= 24) & (F.size(F.split(normalized, " ")) >= 4)


def percent_decode(value: Column) -> Column:
    """Percent-decoding which leaves malformed escapes and plus signs in place."""
    guarded = F.replace(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(guarded)


def redact(message: Column, secrets: tuple[str, ...] = (), limit: int | None = None) -> Column:
    """Message without secrets, URLs and tokens, decoded twice so that encoded ones are found as well; cut to `limit` characters, if given."""
    value = percent_decode(percent_decode(message))
    for secret in filter(None, secrets):
        value = F.replace(value, F.lit(secret), F.lit(vocab.REDACTED_SECRET))
    value = F.regexp_replace(value, rx(vocab.REDACT_URL, "i"), F.lit(vocab.REDACTED_URL))
    value = F.regexp_replace(value, rx(vocab.REDACT_TOKEN, "U"), F.lit(vocab.REDACTED_TOKEN))
    value = squeeze(F.regexp_replace(value, r"\p{C}", " "))
    value = value if limit is None else F.substring(value, 1, limit)
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(vocab.REDACT_EMPTY))


def escape_html(value: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def truncate(value: Column, limit: int) -> Column:
    cut = F.concat(F.rtrim(F.substring(value, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(value) <= limit, value).otherwise(cut)


def display_money(value: Column) -> Column:
    digits = F.format_number(value, 2)
    return F.translate(F.regexp_replace(digits, r"\.?0+$", ""), ",", " ")


def format_budget(low: Column, high: Column, currency: Column) -> Column:
    unit = F.coalesce(currency, F.lit(vocab.BUDGET_TEXT["no_currency"]))
    shown = lambda *parts: F.concat(*parts, F.lit(" "), unit)
    return (F.when(low.isNull() & high.isNull(), F.lit(vocab.BUDGET_TEXT["none"]))
            .when(low == high, shown(display_money(low)))
            .when(low.isNull(), shown(F.lit(vocab.BUDGET_TEXT["up_to"]), display_money(high)))
            .when(high.isNull(), shown(F.lit(vocab.BUDGET_TEXT["from"]), display_money(low)))
            .otherwise(shown(display_money(low), F.lit("–"), display_money(high))))


def fixed_point(value: Column, digits: int) -> Column:
    """Half-even on the exact binary value, without grouping."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def utf16_units(value: Column) -> Column:
    return (F.length(F.encode(value, "UTF-16LE")) / 2).cast("int")


def literal_starts(pattern: str) -> tuple[str, ...] | None:
    """Literal text every alternative of a simple pattern starts with, or None if one has no such start."""
    starts = []
    for branch in re.split(r"\|(?![^(\[]*[)\]])", pattern):
        match = re.match(r"(?:[^\\\[\](){}.*+?|^$]|\\[.+#-])+", branch)
        start = match.group() if match else ""
        if match and branch[match.end():match.end() + 1] in ("?", "*", "{"):
            start = re.sub(r"\\?.$", "", start)
        start = re.sub(r"\\(.)", r"\1", start).lower()
        if not start:
            return None
        starts.append(start)
    return tuple(dict.fromkeys(starts))
