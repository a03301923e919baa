"""Relevance gate and stack compatibility."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.lexicon import (any_term, contains_any, declared_tokens, literals_in, matched_terms, mentioned,
                                 mentioned_names, searchable, term_pattern, unknown_tokens)
from ..functions.text import rx
from ..rules import Profile

ONE_C_LITERALS = ("1", "унф")


def relevance(listings: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Add `relevance` STRUCT<passed, code, reason, matches STRUCT<positive, negative, programming>>."""
    c, patterns = F.col, profile.term_patterns
    texts = listings.withColumns({
        "_title": F.lower("title"),
        "_body": F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))),
        "_category": F.lower(F.coalesce("category", F.lit("")))})
    terms = [term_pattern(term, patterns) for term in chain(profile.positive_terms, profile.negative_terms)]
    folded = texts.withColumns({"_folded": searchable(c("_body")), "_folded_title": searchable(c("_title"))})
    found = folded.withColumn("_folded", literals_in(c("_folded"), terms))
    matched = found.withColumns({
        "_positive": matched_terms("_body", "_folded", profile.positive_terms, patterns),
        "_negative": matched_terms("_body", "_folded", profile.negative_terms, patterns),
        "_intent": c("_title").rlike(rx(profile.intent)),
        "_technical": c("_category").rlike(rx(profile.technical_category))})
    # the title is looked at only where the whole text already holds a negative term
    manual_title = (any_term("_title", "_folded_title", profile.negative_terms, patterns)
                    & c("_title").rlike(rx(profile.manual_action)))
    vetoed = (F.size("_negative") > 0) & ~c("_intent") & (~c("_body").rlike(rx(profile.intent)) | manual_title)
    product = c("_intent") & c("_title").rlike(rx(profile.software_product))
    judged = matched.withColumns({
        "_manual": vetoed, "_programming": (F.size("_positive") > 0) | c("_technical") | product})
    text = vocab.RELEVANCE_TEXT
    first = lambda column, n: F.array_join(F.slice(column, 1, n), ", ")
    signal = (F.when(F.size("_positive") > 0, F.concat(F.lit(text["keywords"]), first("_positive", 8)))
              .when(c("_technical"), F.concat(F.lit(text["category"]), c("_category")))
              .otherwise(F.lit(text["product"])))
    code = (F.when(c("_manual"), "manual_or_nontechnical").when(~c("_programming"), "no_technical_signal")
            .otherwise("technical_relevance"))
    reason = (F.when(c("_manual"), F.concat(F.lit(text["manual"]), first("_negative", 5)))
              .when(~c("_programming"), F.lit(text["none"])).otherwise(signal))
    passed = ~c("_manual") & c("_programming")
    result = F.struct(passed.alias("passed"), code.alias("code"), reason.alias("reason"), F.struct(
        c("_positive").alias("positive"), c("_negative").alias("negative"), passed.alias("programming")).alias("matches"))
    return judged.withColumn("relevance", result).drop(
        "_title", "_body", "_category", "_folded", "_folded_title", "_positive", "_negative", "_intent", "_technical",
        "_manual", "_programming")


def stack_compatibility(listings: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Add `stack` STRUCT<level, points, matches, unsupported, reason, deep_1c>."""
    c = F.col
    all_patterns = tuple(chain(profile.stack_high.values(), profile.stack_partial.values(), profile.stack_low.values()))
    texts = listings.withColumn("_text", F.concat_ws("\n", "title", F.coalesce("description", F.lit(""))))
    folded = texts.withColumn("_folded", searchable(c("_text")))
    found = folded.withColumns({"_found": literals_in(c("_folded"), all_patterns), "_declared": declared_tokens(c("_text"), c("_folded"))})
    named = found.withColumns({
        "_high": mentioned_names("_text", "_found", profile.stack_high),
        "_partial": mentioned_names("_text", "_found", profile.stack_partial),
        "_low": mentioned_names("_text", "_found", profile.stack_low),
        "_one_c": contains_any(c("_folded"), ONE_C_LITERALS) & mentioned("_text", "_folded", vocab.ONE_C)})
    integration, programming = vocab.ONE_C_LABELS
    label = F.when(c("_text").rlike(rx(vocab.ONE_C_INTEGRATION)), integration).otherwise(programming)
    completed = named.withColumns({
        "_partial": F.when(c("_one_c"), F.array_append("_partial", label)).otherwise(c("_partial")),
        "_low": unknown_tokens(c("_declared"), all_patterns, c("_low")),
        "_deep": c("_one_c") & c("_text").rlike(rx(vocab.DEEP_ONE_C, "iUds"))})
    level = (F.when(F.size("_low") > 0, vocab.LOW_UNKNOWN_MATCH).when(F.size("_partial") > 0, vocab.PARTIAL_MATCH)
             .when(F.size("_high") > 0, vocab.HIGH_MATCH).otherwise(vocab.LOW_UNKNOWN_MATCH))
    leveled = completed.withColumn("_level", level)
    named_in = lambda key, column: F.concat(F.lit(vocab.STACK_TEXT[key]), F.array_join(column, ", "))
    reason = (F.when(F.size("_low") > 0, named_in("low", "_low")).when(F.size("_partial") > 0, named_in("partial", "_partial"))
              .when(F.size("_high") > 0, named_in("high", "_high")).otherwise(F.lit(vocab.STACK_TEXT["none"])))
    return leveled.withColumn("stack", F.struct(
        c("_level").alias("level"), _stack_points(c("_level")).alias("points"),
        F.concat("_low", "_partial", "_high").alias("matches"), c("_low").alias("unsupported"),
        reason.alias("reason"), c("_deep").alias("deep_1c"))
    ).drop("_text", "_folded", "_found", "_declared", "_high", "_partial", "_low", "_one_c", "_deep", "_level")


def _stack_points(level: Column) -> Column:
    high, partial, low = (F.lit(vocab.STACK_POINTS[x]) for x in (vocab.HIGH_MATCH, vocab.PARTIAL_MATCH, vocab.LOW_UNKNOWN_MATCH))
    return F.when(level == vocab.HIGH_MATCH, high).when(level == vocab.PARTIAL_MATCH, partial).otherwise(low)
