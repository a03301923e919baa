"""Lexicon matching: whole-word terms, negation-aware mentions, experience requirements.

A regular expression over a long text costs far more than a substring search, so every pattern is tried only on texts
which contain one of the literals its matches start with. The literals come from the pattern itself. Where many patterns
are tried on one text, `literals_in` reads it once for all literals, and the patterns look into the few it found.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from typing import Iterable, Mapping

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import bounded, literal_starts, rx

# literals for the few patterns without a literal start
INNER_LITERALS = {
    vocab.STACK_HIGH["REST API"]: ("api",),
    vocab.STACK_PARTIAL["payment integrations"]: ("payment", "плат", "stripe", "paddle", "lemonsqueezy", "юкасса", "yookassa"),
    vocab.TERM_PATTERNS["наполнение сайта"]: ("сайт",),
    vocab.TERM_PATTERNS["поиск клиентов"]: ("клиент",),
    vocab.TERM_PATTERNS["оператор маркетплейса"]: ("маркетплейс",),
    vocab.TERM_PATTERNS["рассылка контента"]: ("контент",),
}
# literals one of which any match of these patterns contains
DECLARING_LITERALS = ("стек", "stack", "язык", "framework", "фреймворк", "технологии")
REQUIRING_LITERALS = ("на", "using", "requires", "требуется", "обязателен", "нужен", "используется")
MANY_LITERALS = 24
WAIVED_LITERALS = ("опыт", "кейсы", "портфолио")
EXPERIENCE_LITERALS = ("кейс", "портфолио", "senior", "внедрен", "рекомендаци", "cases", "portfolio")


def searchable(text: Column) -> Column:
    """Lower-case form the literals are looked up in (dotless i and long s fold to ASCII in the patterns)."""
    lower = F.lower(text)
    return F.when(lower.contains("ı") | lower.contains("ſ"), F.translate(lower, "ıſ", "is")).otherwise(lower)


def required_literals(pattern: str) -> tuple[str, ...] | None:
    return INNER_LITERALS.get(pattern) or literal_starts(pattern)


def _prefix_tree(words: Iterable[str]) -> str:
    """Pattern of the longest of some words, one branch per next character."""
    branches = {}
    for word in words:
        branches.setdefault(word[:1], []).append(word[1:])
    longer = "|".join(re.escape(first) + _prefix_tree(rest) for first, rest in sorted(branches.items()) if first)
    return f"(?:{longer}){'?' if '' in branches else ''}" if longer else ""


def literals_in(folded: Column, patterns: Iterable[str]) -> Column:
    """The required literals of all patterns that occur in a text, one per line: `folded` for `gated`, found in one pass. A few literals
    are as well looked up in the text itself, which is handed on.

    Each literal a pattern starts with is looked for after anything but a common letter, as patterns are bounded there; the inner ones
    anywhere. A few places more do no harm: the pattern itself decides.
    """
    patterns = tuple(patterns)
    inner = {x for p in patterns for x in INNER_LITERALS.get(p, ())}
    starts = {x for p in patterns if p not in INNER_LITERALS for x in literal_starts(p) or ()}
    if len(starts | inner) < MANY_LITERALS:
        return folded
    found = [f"(?<![a-zа-яё0-9_])({_prefix_tree(starts)})"] if starts else []
    found += [f"({_prefix_tree(inner)})"] if inner else []
    hits = [F.array_join(F.regexp_extract_all(folded, F.lit(f"(?={p})"), F.lit(1)), "\n") for p in found]
    return F.concat_ws("\n", *hits)


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(folded: Column, literals: Iterable[str]) -> Column:
    return reduce(or_, (folded.contains(x) for x in literals))


def gated(folded: str, pattern: str, test: str) -> str:
    """SQL condition `test`, tried only where a literal of the pattern occurs in the column `folded`."""
    literals = required_literals(pattern)
    if not literals:
        return test
    return "((" + " OR ".join(f"contains({folded}, {quoted(x)})" for x in literals) + f") AND {test})"


def named_hits(tests: Mapping[str, str]) -> Column:
    """Array of the names whose SQL condition holds, in the given order."""
    # a joined text instead of array_compact(array(...)): the latter is a higher-order function, whose arguments Spark
    # evaluates outside of generated code
    cases = ", ".join(f"CASE WHEN {test} THEN {quoted(name)} END" for name, test in tests.items())
    if not cases:
        return F.array().cast("array<string>")
    return F.expr(f"coalesce(split(nullif(concat_ws('\\u0001', {cases}), ''), '\\u0001'), cast(array() AS array<string>))")


def named_columns(tests: Iterable[tuple[str, Column]]) -> Column:
    """As `named_hits`, for conditions given as columns."""
    joined = F.concat_ws("\x01", *[F.when(test, F.lit(name)) for name, test in tests])
    return F.coalesce(F.split(F.nullif(joined, F.lit("")), "\x01"), F.array().cast("array<string>"))


def term_pattern(term: str, patterns: Mapping[str, str]) -> str:
    return patterns.get(term, re.escape(term))


def _has_term(text: str, folded: str, term: str, patterns: Mapping[str, str]) -> str:
    pattern = term_pattern(term, patterns)
    return gated(folded, pattern, f"rlike({text}, {quoted(bounded(pattern))})")


def matched_terms(text: str, folded: str, terms: Iterable[str], patterns: Mapping[str, str]) -> Column:
    """Terms found in the column `text`, in lexicon order; `folded` names its `searchable` form."""
    return named_hits({t: _has_term(text, folded, t, patterns) for t in terms})


def any_term(text: str, folded: str, terms: Iterable[str], patterns: Mapping[str, str]) -> Column:
    return F.expr(" OR ".join(_has_term(text, folded, t, patterns) for t in terms) or "false")


def pattern_start(pattern: str) -> str:
    """Guard which keeps the costly look-behinds for places where the pattern itself fits."""
    return f"(?:{pattern})"


def mention_pattern(pattern: str) -> str:
    """Pattern which steps over every mention and captures only those that are not excluded.

    At each position the atomic core takes the same text in all three branches, so an excluded mention is consumed as a
    whole and a shorter mention inside it is not found again.
    """
    core = rf"(?>(?:{pattern})(?!\w))"
    before = "|".join(rf"{word}\s{{0,{vocab.NEGATION_WIDTH_BEFORE - len(word)}}}" for word in vocab.NEGATORS_BEFORE)
    room = vocab.NEGATION_WIDTH_BEFORE - len(vocab.EXPERIENCE_WORD)
    experience = rf"{vocab.EXPERIENCE_WORD}\w{{0,{room}}}\s{{0,{room}}}"
    return rx(rf"(?<!\w)(?={pattern_start(pattern)})(?:(?<={before}){core}|(?<!{experience}){core}(?={vocab.NEGATED_AFTER})|({core}))")


def _mentioned(text: str, folded: str, pattern: str) -> str:
    found = f"array_join(regexp_extract_all({text}, {quoted(mention_pattern(pattern))}, 1), '') <> ''"
    return gated(folded, pattern, found)


def mentioned(text: str, folded: str, pattern: str) -> Column:
    """Is the technology named anywhere without being excluded?"""
    return F.expr(_mentioned(text, folded, pattern))


def mentioned_names(text: str, folded: str, patterns: Mapping[str, str]) -> Column:
    return named_hits({name: _mentioned(text, folded, pattern) for name, pattern in patterns.items()})


def _fold_unique(tokens: Column, known: Column) -> Column:
    """Append tokens not yet present, ignoring case."""
    return F.aggregate(tokens, known, lambda kept, t: F.when(
        F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.array_append(kept, t)))


def declared_tokens(text: Column, folded: Column) -> Column:
    """Technology names a text declares as its stack or requires by name, in order of appearance."""
    none = F.array().cast("array<string>")
    listed = F.when(contains_any(folded, DECLARING_LITERALS), F.regexp_extract_all(
        text, F.lit(rx(vocab.DECLARED_STACK)), F.lit(1))).otherwise(none)
    first_sentence = lambda d: F.get(F.split(d, rx(vocab.DECLARED_SENTENCE_END, "Ud"), 2), 0)
    names = F.flatten(F.transform(listed, lambda d: F.regexp_extract_all(
        first_sentence(d), F.lit(rx(vocab.DECLARED_TOKEN)), F.lit(0))))
    required = F.when(contains_any(folded, REQUIRING_LITERALS), F.regexp_extract_all(
        text, F.lit(rx(vocab.REQUIRED_TOKEN)), F.lit(1))).otherwise(none)
    return F.concat(names, required)


def unknown_tokens(declared: Column, known_patterns: Iterable[str], named: Column) -> Column:
    """`named` extended by the `declared_tokens` that no pattern of the profile knows."""
    known = bounded("|".join(known_patterns))
    tokens = F.transform(declared, lambda t: F.rtrim(t, F.lit(".")))
    unknown = F.filter(tokens, lambda t: ~F.lower(t).isin(*vocab.TOKEN_STOP_WORDS) & ~t.rlike(known))
    return F.when(F.size(declared) > 0, _fold_unique(unknown, named)).otherwise(named)


def without_waivers(text: Column) -> Column:
    """A lower-case text without the places which say that no experience is needed."""
    waived = text.contains("не") & contains_any(text, WAIVED_LITERALS)
    return F.when(waived, F.regexp_replace(text, rx(vocab.EXPERIENCE_NOT_NEEDED), "")).otherwise(text)


def experience_required(text: Column, cleared: Column | None = None) -> Column:
    """Is long or proven experience demanded (lower-case text)? `cleared`: a column that holds `without_waivers(text)`."""
    text = without_waivers(text) if cleared is None else cleared
    take = lambda group: F.regexp_extract_all(text, F.lit(rx(vocab.EXPERIENCE_YEARS + r"(?=([\s\S]{0,20}))")), F.lit(group))
    # a mention is judged by up to 45 characters before it and 20 after it; the fold hands on the end of the text read so far, and all
    # that reads the whole text stands outside of it, where it is evaluated once
    pieces = F.split(text, rx(vocab.EXPERIENCE_YEARS), -1)
    mentions = F.filter(F.arrays_zip(take(0).alias("span"), take(1).alias("years"), take(3).alias("plus"), take(4).alias("after"),
                                     pieces.alias("piece")), lambda m: m["span"].isNotNull())

    def judge(read, m):
        before = F.right(F.concat(read["tail"], m["piece"]), F.lit(45))
        enough = (F.length(m["years"]) > 9) | (m["years"].try_cast("int") >= 3)
        wanted = (m["plus"] != "") | F.concat(before, m["after"]).rlike(rx(vocab.EXPERIENCE_CONTEXT))
        return F.struct(F.right(F.concat(before, m["span"]), F.lit(45)).alias("tail"), (read["found"] | (enough & wanted)).alias("found"))

    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("found")).cast("struct<tail:string,found:boolean>")
    long_enough = F.aggregate(mentions, start, judge)["found"]
    proven = text.rlike(rx(vocab.EXPERIENCE_CONTEXT + vocab.EXPERIENCE_CASES_AFTER + "|" + vocab.EXPERIENCE_CASES))
    dated = contains_any(text, ("лет", "год", "year")) & text.rlike(r"(?U)\d")
    return F.when(dated, long_enough).otherwise(F.lit(False)) | (contains_any(text, EXPERIENCE_LITERALS) & proven)
