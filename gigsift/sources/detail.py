"""Confirmation of listings by their original card."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.text import full, rx
from ..functions.values import closed_status, parse_publication_time
from ..operators.score import assess, moment
from ..operators.views import top_per_source
from ..rules import Profile
from .html import any_of, attribute, find, find_all, tag, text_of, texts_of, tidy, raw_text, with_page
from .layouts import page_challenge

DETAIL_SOURCES = ("fl_ru",)


def detail_candidates(listings: DataFrame, now: datetime | Column, profile: Profile = Profile(), n: int = vocab.MAX_DETAIL_CARDS) -> DataFrame:
    """(row_id, source, source_id, rank): the best `n` per source if their listing date were confirmed."""
    provisional = listings.filter(F.col("source").isin(*DETAIL_SOURCES)).withColumns({
        "publication_confirmed": F.lit(True), "publication_evidence": F.lit("listing estimate, awaiting original card")})
    return top_per_source(assess(provisional, now, profile).filter("eligible"), n).select("row_id", "source", "source_id", "rank")


def _unhidden(node: Column) -> Column:
    """No attribute of the element switches it off."""
    flag = lambda name: F.lower(F.coalesce(attribute(node, name), F.lit(""))) == "true"
    off = (attribute(node, "disabled").isNotNull() | attribute(node, "hidden").isNotNull() | flag("aria-disabled") | flag("aria-hidden")
           | F.arrays_overlap(node["classes"], F.array(F.lit("disabled"), F.lit("hidden"), F.lit("d-none")))
           | F.coalesce(attribute(node, "style"), F.lit("")).rlike(rx(r"display\s*:\s*none|visibility\s*:\s*hidden")))
    return ~off


def read_cards(detail_pages: DataFrame, now: datetime | Column) -> DataFrame:
    """(source, source_id, card_error, date_text, confirmed_at, closed, closed_evidence, reply_open) of original cards."""
    c = F.col
    flat = with_page(detail_pages, "source", "source_id")
    own = F.exists("nodes", lambda n: F.coalesce(attribute(n, "id") == F.concat(F.lit("projectp"), c("source_id")), F.lit(False)))
    brief = any_of(tag("*", "fl-project-content__description-text"), lambda n: attribute(n, "id").startswith("projectp"),
                   tag("*", "b-post__txt"), tag("h1"), tag("h2"), tag("*", "comment"), tag("*", "b-comment"))
    labels = any_of(tag("*", data_id="qa-order-status"), tag("*", "fl-project-status"), tag("*", "b-status"))
    read = flat.withColumns({
        "_title": find(tag("title")), "_own": own, "_labels": texts_of(labels),
        "_dated": F.filter(texts_of(tag("*", "text-10", "opacity-50")), lambda s: s.rlike(full(vocab.ORIGINAL_CARD_DATE, "U"))),
        "_cut": F.transform(find_all(lambda n: F.coalesce(brief(n), F.lit(False))), lambda n: F.struct(n["id"].alias("id"), n["stop"].alias("stop")))})
    pick = lambda group: F.regexp_extract(F.get("_dated", 0), full(vocab.ORIGINAL_CARD_DATE, "U"), group)
    facts = read.withColumns({
        "card_error": F.when(page_challenge(c("_title")), "challenge_page").when(~c("_own"), "unrecognized_project_card"),
        "date_text": F.when(F.size("_dated") == 1, F.concat_ws(" ", pick(1), pick(2))),
        "label": F.get(F.filter("_labels", lambda t: closed_status(t).isNotNull()), 0),
        # the customer's brief and the replies say nothing about the state of the order
        "rest": find_all(lambda n: ~F.exists("_cut", lambda x: (x["id"] <= n["id"]) & (n["id"] <= x["stop"])))})
    words = F.transform(find_all(lambda n: n["tag"] == "#text", "rest"), lambda n: tidy(raw_text(n)))
    rest = facts.withColumns({
        "_loose": F.get(F.filter(words, lambda t: closed_status(t).isNotNull()), 0),
        "_offer": find(lambda n: attribute(n, "id") == "reply_offer", "rest")})
    chain = find_all(lambda n: (n["tag"] != "#text") & (n["id"] <= c("_offer.id")) & (c("_offer.id") <= n["stop"]), "rest")
    loose, reply_open = c("_loose"), c("_offer").isNotNull() & F.forall(chain, _unhidden)
    return rest.select(
        "source", "source_id", "card_error", "date_text",
        parse_publication_time(c("date_text"), moment(now)).alias("confirmed_at"),
        F.coalesce(closed_status(loose), closed_status(c("label"))).alias("closed"),
        F.coalesce(loose, c("label")).alias("closed_evidence"), F.coalesce(reply_open, F.lit(False)).alias("reply_open"))


def confirm(listings: DataFrame, candidates: DataFrame, detail_pages: DataFrame, now: datetime | Column) -> tuple[DataFrame, DataFrame]:
    """(listings with confirmed fields, detail log). Reading ends per source at the first restricted card."""
    c = F.col
    cards = read_cards(detail_pages.join(F.broadcast(candidates.select("source", "source_id").distinct()), ["source", "source_id"], "left_semi"), now)
    fetch_error = detail_pages.select("source", "source_id", *([c("error").alias("_fetch_error")] if "error" in detail_pages.columns
                                                              else [F.lit(None).cast("string").alias("_fetch_error")]))
    tried = candidates.join(cards, ["source", "source_id"], "left").join(fetch_error, ["source", "source_id"], "left")
    unread = F.when(c("card_error").isNull() & c("date_text").isNull() & c("closed").isNull() & c("reply_open").isNull(), "network_error")
    failed = tried.withColumn("_failed", F.coalesce("_fetch_error", "card_error", unread))
    earlier = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(c("_failed").isin(*vocab.STOP_CODES)).over(earlier), F.lit(False))
    reached = failed.withColumn("_stopped", stopped).filter(~c("_stopped"))
    read = reached.filter(c("_failed").isNull())
    changed = listings.join(read.select(
        "row_id", F.lit(True).alias("_read"), "date_text", "confirmed_at", "closed", "closed_evidence", "reply_open"), "row_id", "left")
    opened = (c("open_status") == "unknown") & c("reply_open")
    status = F.coalesce(c("closed"), F.when(opened, "open"), c("open_status"))
    evidence = F.coalesce(c("closed_evidence"), F.when(opened, "original card: reply_offer"), c("status_evidence"))
    on_card = lambda new, old: F.when(c("_read"), new).otherwise(c(old)).alias(old)
    updated = changed.select(
        *[c(name) for name in listings.columns if name not in REWRITTEN],
        on_card(c("confirmed_at"), "published_at"), on_card(c("confirmed_at").isNotNull(), "publication_confirmed"),
        on_card(F.when(c("confirmed_at").isNotNull(), F.concat(F.lit("original card: Опубликован "), c("date_text"), F.lit(" (MSK)"))),
                "publication_evidence"),
        on_card(status, "open_status"), on_card(evidence, "status_evidence"))
    error = F.coalesce(c("_failed"), F.when(c("confirmed_at").isNull(), "unconfirmed_original_publication"))
    log = reached.select("source", "row_id", "source_id", "rank", c("_failed").isNull().alias("fetched"), error.alias("error"))
    return updated, log


REWRITTEN = ("published_at", "publication_confirmed", "publication_evidence", "open_status", "status_evidence")
