"""Listing extraction: one row per card, described by a layout per source.

A layout says what a card is and which columns its fields are; `extract` does the rest in one pass over the pages. New
sources are added by registering another layout.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.text import full, rx
from ..functions.urls import absolute, canonical_url, is_project_link, normal_https, safe_url, url_error, url_host, url_path
from ..functions.values import closed_status, parse_budget, parse_count, parse_publication_time, post_skip_reason
from ..operators.normalize import validate
from ..operators.score import moment
from ..rules import Profile
from ..schema import row_id
from ..session import checkpoint, settled
from .html import (BREAK, any_of, attribute, below, find, find_all, inside, nearest_above, parent_of, raw_text, tag, text_of,
                   texts_of, with_page)


@dataclass(frozen=True)
class Layout:
    """How one source lays out its listing pages.

    `locate` lists steps which name the elements of a card (columns over `nodes` and over earlier steps); `raw` reads
    texts and attributes from them; `parsed` maps listing fields, `_error` (a card error code or NULL) and `_drop`
    ("filtered", "ignored" or NULL) to columns over the raw ones and `heading`.
    """

    source: str
    card: Callable[[Column], Column]
    locate: Callable[[], list[dict[str, Column]]]
    raw: Callable[[], dict[str, Column]]
    parsed: Callable[[Column, Profile], dict[str, Column]]
    empty_marker: Callable[[], Column] | None = None
    no_cards: str = "unrecognized_listing_layout"
    filtered_is_success: bool = False


LAYOUTS: dict[str, Layout] = {}


def register(layout: Layout) -> Layout:
    LAYOUTS[layout.source] = layout
    return layout


def _resolve_links(raw: DataFrame, source: str) -> DataFrame:
    """Add `_refused` and `_link_url`, the error and the safe URL of the card link in column `href`. Each step is a projection of its own:
    the link is then resolved and judged once for a card, not once for each use."""
    base, hosts = F.lit(vocab.SOURCE_BASE_URLS[source]), vocab.SOURCE_HOSTS[source]
    resolved = raw.withColumn("_resolved", absolute(F.col("href"), base))
    judged = resolved.withColumn("_refused", url_error(F.col("href"), base, hosts, F.col("_resolved")))
    return judged.withColumn("_link_url", F.when(F.col("_refused").isNull(), normal_https(F.col("_resolved"))))


def _link(source: str, missing: str, invalid: str, group: int = 1) -> dict[str, Column]:
    """source_id, url and error of the card link, after `_resolve_links`."""
    url = F.col("_link_url")
    card = F.regexp_extract(url_path(url), full(vocab.CARD_PATHS[source][1], "U"), group)
    error = F.coalesce(F.when(F.col("href").isNull(), missing), F.col("_refused"),
                       F.when(F.coalesce(card, F.lit("")) == "", invalid))
    return {"source_id": card, "url": url, "_error": error}


def _budget(text: Column) -> dict[str, Column]:
    budget = parse_budget(text)
    return {"budget_min": budget["low"], "budget_max": budget["high"], "currency": budget["currency"]}


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _is_id(value: str):
    return lambda node: attribute(node, "id").startswith(value)


# --- fl_ru -----------------------------------------------------------------------------------------------------

def _fl_locate() -> list[dict[str, Column]]:
    foot = tag("*", "b-post__foot")
    return [{
        "_link": find(inside(tag("h2"), tag("a", href=None))), "_kind": find(inside(foot, tag("*", "b-post__bold"))),
        "_price": find(tag("*", "b-post__price")), "_age": find(inside(foot, tag("span", "text-gray-opacity-4"))),
        "_label": find(tag("*", data_id="qa-order-status")), "_replies": find(tag("*", data_id="fl-view-count-href")),
        "_icon": find(tag("*", title="Количество ответов")), "_brief": find(inside(tag("*", "b-post__body"), tag("*", "b-post__txt"))),
    }, {"_beside": parent_of("_icon")}]


def _fl_raw() -> dict[str, Column]:
    c = F.col
    return {
        "href": attribute(c("_link"), "href"), "link_text": text_of(c("_link")), "kind": text_of(c("_kind")),
        "price": text_of(c("_price")), "age_text": text_of(c("_age")), "label": text_of(c("_label")),
        "replies": F.coalesce(_or_null(text_of(c("_replies"))), text_of(c("_beside"))), "brief": text_of(c("_brief")),
        "pinned": F.array_contains(F.get("nodes", 0)["classes"], "topprjpay"),
    }


def _fl_parsed(now: Column, profile: Profile) -> dict[str, Column]:
    c = F.col
    category = F.lit(None).cast("string")
    for word, name in reversed(vocab.HEADING_CATEGORIES):
        category = F.when(F.lower("heading").contains(word), name).otherwise(category)
    return {
        **_link("fl_ru", "missing_title_link", "invalid_project_link"), **_budget(c("price")),
        "_drop": F.when(c("kind").rlike(rx(vocab.SKIPPED_CARD_KIND)), "filtered"),
        "title": c("link_text"), "description": _or_null(c("brief")),
        "published_at": parse_publication_time(c("age_text"), now),
        "publication_evidence": F.when(c("age_text") != "", F.concat(F.lit("unconfirmed listing age: "), c("age_text"))),
        "responses_count": parse_count(c("replies")), "open_status": F.coalesce(closed_status(c("label")), F.lit("unknown")),
        "status_evidence": _or_null(c("label")), "category": F.when(~c("pinned"), category),
    }


register(Layout("fl_ru", _is_id("project-item"), _fl_locate, _fl_raw, _fl_parsed, filtered_is_success=True))


# --- freelance_ru ----------------------------------------------------------------------------------------------

def _freelance_locate() -> list[dict[str, Column]]:
    item, foot = tag("*", "task-card__foot-item"), tag("*", "task-card__foot")
    return [{
        "_link": find(tag("a", "task-card__title-link", href=None)), "_price": find(tag("*", "task-card__budget")),
        "_desc": find(tag("*", "task-card__desc")), "_meta": find(tag("*", "task-card__meta-rows")),
        "_clock": find(inside(tag("*", "task-card__foot-item", title=None), tag("*", "fa-clock-o"))),
        "_comments": find(inside(foot, tag("*", "fa-comments"))), "_views": find(inside(foot, tag("*", "fa-eye"))),
    }, {"_dated": nearest_above("_clock", item), "_by_comments": parent_of("_comments"), "_by_views": parent_of("_views")}]


def _freelance_raw() -> dict[str, Column]:
    c = F.col
    item = tag("*", "task-card__foot-item")
    labels = texts_of(any_of(tag("*", "task-card__status"), tag("*", "task-badge"), item))
    return {
        "href": attribute(c("_link"), "href"), "link_text": text_of(c("_link")), "price": text_of(c("_price")),
        "parts": F.filter(F.concat(F.array(text_of(c("_desc")), text_of(c("_meta"))),
                                   F.filter(texts_of(item), lambda t: t.contains("Опыт:"))), lambda t: t != ""),
        "clock": F.coalesce(attribute(c("_dated"), "title"), F.lit("")),
        "closed_label": F.get(F.filter(labels, lambda t: closed_status(t).isNotNull()), 0),
        "comments": text_of(c("_by_comments")), "views": text_of(c("_by_views")),
        "chips": texts_of(inside(tag("*", "task-card__chips"), tag("*", "task-chip"))),
        "premium": F.exists("nodes", tag("*", "task-badge--premium")) | F.array_contains(F.get("nodes", 0)["classes"], "task-card--premium"),
    }


def _freelance_parsed(now: Column, profile: Profile) -> dict[str, Column]:
    c = F.col
    at = F.when(c("clock").rlike(r"\A\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}\z"), parse_publication_time(c("clock"), now))
    return {
        **_link("freelance_ru", "missing_link", "invalid_project_path"), **_budget(c("price")),
        "_drop": F.when(c("premium"), "ignored"),
        "title": c("link_text"), "description": _or_null(F.array_join("parts", " ")), "published_at": at,
        "publication_confirmed": at.isNotNull(),
        "publication_evidence": F.when(at.isNotNull(), F.concat(F.lit("task-card clock title: "), c("clock"), F.lit(" (MSK)"))),
        "open_status": F.coalesce(closed_status(c("closed_label")), F.lit("unknown")), "status_evidence": c("closed_label"),
        "responses_count": parse_count(c("comments")), "views_count": parse_count(c("views")),
        "category": _or_null(F.array_join("chips", " / ")),
    }


register(Layout("freelance_ru", tag("article", "task-card"), _freelance_locate, _freelance_raw, _freelance_parsed,
                empty_marker=lambda: F.exists("nodes", inside(tag("*", "task-feed-list"), tag("*", "empty")))))


# --- habr_freelance --------------------------------------------------------------------------------------------

def _habr_locate() -> list[dict[str, Column]]:
    return [{
        "_link": find(inside(tag("*", "task__title"), tag("a", href=None))), "_time": find(tag("time", datetime=None)),
        "_price": find(tag("*", "task__price")), "_brief": find(tag("*", "task__description")),
        "_replies": find(tag("*", "params__responses")), "_tags": find(tag("*", "task__tags"))}]


def _habr_raw() -> dict[str, Column]:
    c = F.col
    return {
        "href": attribute(c("_link"), "href"), "link_text": text_of(c("_link")), "time": attribute(c("_time"), "datetime"),
        "price": text_of(c("_price")), "brief": text_of(c("_brief")), "replies": text_of(c("_replies")), "tags": text_of(c("_tags")),
    }


def _habr_parsed(now: Column, profile: Profile) -> dict[str, Column]:
    c = F.col
    return {
        **_link("habr_freelance", "missing_title_link", "invalid_task_url"), **_budget(c("price")),
        "title": c("link_text"), "description": _or_null(c("brief")), "published_at": parse_publication_time(c("time"), now),
        "responses_count": parse_count(c("replies")), "category": _or_null(c("tags")),
    }


register(Layout("habr_freelance", tag("article", "task"), _habr_locate, _habr_raw, _habr_parsed))


# --- weblancer -------------------------------------------------------------------------------------------------

def _weblancer_locate() -> list[dict[str, Column]]:
    return [
        {"_link": find(inside(tag("h2"), tag("a", href=None))), "_brief": find(tag("p")), "_spans": texts_of(tag("span"))},
        {"_heading": nearest_above("_link", tag("h2"))},
        {"_row": parent_of("_heading")},
        {"_price": find(lambda n: tag("span", "whitespace-nowrap")(n) & below(F.col("_row"))(n))},
    ]


def _weblancer_raw() -> dict[str, Column]:
    c = F.col
    first = lambda pattern: F.get(F.filter("_spans", lambda s: s.rlike(full(pattern))), 0)
    tags = lambda n: (tag("a", href=None)(n) & (n["id"] != F.coalesce(c("_link.id"), F.lit(-1)))
                      & attribute(n, "href").rlike(r"\A/freelance/[^/]+/\z"))
    return {
        "href": attribute(c("_link"), "href"), "link_text": text_of(c("_link")), "price": text_of(c("_price")),
        "date": first(r"\d{2}\.\d{2}\.\d{4}"), "replies": first(r"[\d\s]+\s+заяв\w*"), "views": first(r"[\d\s]+\s+просмотр\w*"),
        "brief": text_of(c("_brief")), "tags": texts_of(tags),
    }


def category_label(slug: Column) -> Column:
    """Readable name of a category, the slug itself if it is not known."""
    label = slug
    for known, name in vocab.WEBLANCER_CATEGORIES.items():
        label = F.when(slug == known, name).otherwise(label)
    return label


def _weblancer_parsed(now: Column, profile: Profile) -> dict[str, Column]:
    c = F.col
    link = _link("weblancer", "missing_link", "invalid_project_path")
    label = category_label(F.regexp_extract(url_path(link["url"]), full(r"/freelance/([^/]+)-\d+/[^/]+-(\d+)/?", "U"), 1))
    return {
        **link, **_budget(c("price")), "title": c("link_text"), "description": _or_null(c("brief")),
        "published_at": parse_publication_time(c("date"), now), "responses_count": parse_count(c("replies")),
        "views_count": parse_count(c("views")), "category": F.array_join(F.concat(F.array(label), c("tags")), ", "),
    }


register(Layout("weblancer", tag("article"), _weblancer_locate, _weblancer_raw, _weblancer_parsed))


# --- telegram_public -------------------------------------------------------------------------------------------

def _post_locate() -> list[dict[str, Column]]:
    return [{"_text": find(tag("*", "tgme_widget_message_text")),
             "_time": find(inside(tag("*", "tgme_widget_message_date"), tag("time", datetime=None)))}]


def _post_raw() -> dict[str, Column]:
    c = F.col
    links = find_all(lambda n: tag("a", href=None)(n) & below(c("_text"))(n))
    return {
        "post": attribute(F.get("nodes", 0), "data-post"), "lines_text": F.translate(raw_text(c("_text")), BREAK, "\n"),
        "brief": text_of(c("_text")), "time": F.coalesce(attribute(c("_time"), "datetime"), F.lit("")),
        "hrefs": F.coalesce(F.transform(links, lambda n: attribute(n, "href")), F.array().cast("array<string>")),
        "forwarded": F.exists("nodes", tag("*", "tgme_widget_message_forwarded_from")),
    }


def content_lines(text: Column) -> Column:
    """Non-empty lines of a text with collapsed whitespace."""
    lines = F.split(F.coalesce(text, F.lit("")), r"[\n\x0b\x0c\u0085  ]")
    tidy = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"[\p{C}&&[^\t]]", ""), r"(?U)\s+", " ")))
    return F.filter(tidy, lambda s: s != "")


def first_content_line(lines: Column, limit: int = 180) -> Column:
    """First line which is more than hashtags, else the first line."""
    spoken = F.filter(lines, lambda s: ~s.rlike(full(r"(?:#\w+\s*)+")))
    return F.substring(F.coalesce(F.get(spoken, 0), F.get(lines, 0)), 1, limit)


def external_link(hrefs: Column, own: Column) -> Column:
    """Link of a post to the order: a project link first, else the first link which is not a bare host or a profile."""
    accepted = F.filter(F.transform(hrefs, lambda h: safe_url(h)), lambda u: u.isNotNull() & (u != own) & ~url_path(u).isin("", "/"))
    marked = F.transform(accepted, lambda u: F.struct(u.alias("url"), is_project_link(canonical_url(u)).alias("project")))
    useful = F.filter(marked, lambda m: m["project"] | (url_host(m["url"]) != "t.me"))
    return F.coalesce(F.get(F.filter(useful, lambda m: m["project"]), 0)["url"], F.get(useful, 0)["url"])


def _post_parsed(now: Column, profile: Profile) -> dict[str, Column]:
    c = F.col
    name = full(f"({vocab.CHANNEL_NAME})/(\\d+)", "U")
    channel = F.lower(F.regexp_extract("post", name, 1))
    number = F.regexp_extract("post", name, 2)
    url = F.concat(F.lit("https://t.me/"), channel, F.lit("/"), number)
    lines = content_lines(c("lines_text"))
    external = external_link(c("hrefs"), url)
    budget_line = F.get(F.filter(lines, lambda s: s.rlike(rx(r"\A" + vocab.BUDGET_LINE))), 0)
    known = (channel != "") & channel.isin(*profile.channels)
    return {
        "_error": F.when(~F.coalesce(known, F.lit(False)), "unexpected_post_channel"),
        "_drop": F.when(known & (c("brief") == ""), "filtered"),
        "source_id": F.concat_ws("_", channel, number), "url": url, "channel": channel,
        "title": first_content_line(lines), "description": c("brief"),
        "published_at": F.when(c("time").rlike(r"(?:Z|[+-]\d{2}:\d{2})\z"), parse_publication_time(c("time"), now)),
        **_budget(F.coalesce(budget_line, F.lit(""))), "external_url": external,
        "origin_kind": F.when(c("forwarded") | external.isNotNull(), "repost").otherwise("direct_post"),
        "discovery_skip_reason": post_skip_reason(c("brief"), profile),
    }


register(Layout("telegram_public", tag("*", "tgme_widget_message", data_post=None), _post_locate, _post_raw, _post_parsed,
                no_cards="public_preview_unavailable_or_empty", filtered_is_success=True))


# --- the job ---------------------------------------------------------------------------------------------------

def challenge_form(node: Column) -> Column:
    return ((node["tag"] == "form") & attribute(node, "action").contains("captcha")) | (attribute(node, "id") == "challenge-form")


def page_challenge(title: Column) -> Column:
    """Is the page a browser check instead of content?"""
    return text_of(title).rlike(rx(vocab.CHALLENGE_TITLE)) | F.exists("nodes", lambda n: F.coalesce(challenge_form(n), F.lit(False)))


LINEAGE = ("source", "page_url", "page_no", "seq", "page_error", "cards_cut", "card_ord")


def flat_pages(pages: DataFrame) -> DataFrame:
    """(source, page_url, page_no, seq, refused, nodes, text, base) of each page; one that exceeds the size limit is not parsed."""
    c = F.col
    too_large = F.coalesce(F.octet_length("html") > vocab.MAX_PAGE_BYTES, F.lit(False))
    fitting = pages.withColumns({"refused": F.when(too_large, "response_too_large"), "html": F.when(~too_large, c("html"))})
    return with_page(fitting, "source", c("url").alias("page_url"), "page_no", "seq", "refused")


def _cards(flat: DataFrame, layout: Layout, most: int | None) -> DataFrame:
    """One row per card with its nodes and text, or one row without nodes for a page that yields none. Of more than `most` cards on a page,
    where that is set, the first are taken; cards_cut counts the others."""
    c = F.col
    spans = F.transform(find_all(layout.card), lambda n: F.struct(n["id"].alias("id"), n["stop"].alias("stop"),
                                                                 n["start"].alias("start"), n["size"].alias("size")))
    located = flat.withColumns({"_title": find(tag("title")), "_h1": find(tag("h1")), "_all": spans})
    located = located.withColumns({"spans": c("_all") if most is None else F.slice("_all", 1, most)})
    located = located.withColumn("cards_cut", F.size("_all") - F.size("spans")).drop("_all")
    empty = layout.empty_marker() if layout.empty_marker else F.lit(False)
    error = F.when(c("refused").isNotNull(), c("refused")).when(page_challenge(c("_title")), "challenge_page").when((F.size("spans") == 0) & ~empty, layout.no_cards)
    judged = located.withColumns({"heading": text_of(c("_h1")), "page_error": error})
    cut = F.when(c("page_error").isNull(), F.transform("spans", lambda s: F.struct(
        F.slice("nodes", s["id"] + 1, s["stop"] - s["id"] + 1).alias("nodes"),
        F.substring("text", s["start"] + 1, s["size"]).alias("text"), s["start"].alias("base"))))
    rows = judged.select("source", "page_url", "page_no", "seq", "heading", "page_error", "cards_cut", F.posexplode_outer(cut).alias("card_ord", "card"))
    return rows.select("source", "page_url", "page_no", "seq", "heading", "page_error", "cards_cut", "card_ord", "card.nodes", "card.text", "card.base")


def extract(pages: DataFrame, layout: Layout, now: datetime | Column, profile: Profile = Profile(),
            description_limit: int | None = None) -> DataFrame:
    """One row per card of `pages`, raw or made by `flat_pages`: lineage, `card_state` (ok, invalid, filtered, ignored or NULL), `card_error` and listing fields."""
    c = F.col
    own = pages.filter(c("source") == layout.source)
    cards = _cards(own if "nodes" in own.columns else flat_pages(own), layout, profile.max_cards_per_page)
    located = reduce(lambda df, step: df.withColumns(step), layout.locate(), cards)
    raw = located.select(*LINEAGE, "heading", *[value.alias(name) for name, value in layout.raw().items()])
    raw = _resolve_links(raw, layout.source) if "href" in raw.columns and layout.source in vocab.SOURCE_BASE_URLS else raw
    fields = {"_drop": F.lit(None).cast("string"), "_error": F.lit(None).cast("string"), **layout.parsed(moment(now), profile)}
    parsed = raw.select(*LINEAGE, *[value.alias(name) for name, value in fields.items()])
    order = F.lit(vocab.SOURCE_ORDER.index(layout.source) if layout.source in vocab.SOURCE_ORDER else len(vocab.SOURCE_ORDER))
    numbered = parsed.withColumn("row_id", row_id(order, c("seq"), F.coalesce("card_ord", F.lit(0))))
    checked = validate(numbered, description_limit, resolved=True)
    error = F.coalesce(c("_error"), F.get("errors", 0))
    state = (F.when(c("card_ord").isNull(), F.lit(None).cast("string")).when(c("_drop").isNotNull(), c("_drop"))
             .when(error.isNotNull(), "invalid").otherwise("ok"))
    done = checked.withColumns({"card_state": state, "card_error": F.when(state == "invalid", error)}).drop("_drop", "_error", "errors")
    return settled(done, "card_state", "card_error")


def extract_all(pages: DataFrame, now: datetime | Column, profile: Profile = Profile()) -> DataFrame:
    """Cards of all enabled sources. Pages are read and parsed once, whatever the number of layouts."""
    enabled = [layout for name, layout in LAYOUTS.items() if name not in profile.disabled_sources]
    flat = checkpoint(flat_pages(pages.filter(F.col("source").isin([layout.source for layout in enabled]))))
    parts = [extract(flat, layout, now, profile) for layout in enabled]
    return reduce(lambda a, b: a.unionByName(b), parts)


def page_log(cards: DataFrame) -> DataFrame:
    """(source, url, page_no, seq, error, parse_errors, filtered_count, cards, cards_cut): the result of each page."""
    c = F.col
    counted = cards.groupBy("source", c("page_url").alias("url"), "page_no", "seq").agg(
        F.max("page_error").alias("page_error"), F.count_if(c("card_state") == "ok").alias("cards"),
        F.count_if(c("card_state") == "invalid").alias("invalid"), F.count_if(c("card_state") == "filtered").alias("filtered_count"),
        F.count_if(c("card_state") == "ignored").alias("ignored"), F.coalesce(F.max("cards_cut"), F.lit(0)).cast("bigint").alias("cards_cut"))
    lenient = c("source").isin(*[name for name, layout in LAYOUTS.items() if layout.filtered_is_success])
    all_bad = (c("cards") == 0) & (c("invalid") > 0) & ~(lenient & (c("filtered_count") > 0))
    error = F.coalesce(c("page_error"), F.when(all_bad, "all_cards_invalid"))
    return counted.withColumn("error", error).withColumn(
        "parse_errors", F.when(c("error").isNotNull() & (c("invalid") == 0), 1).otherwise(c("invalid"))
    ).drop("page_error", "invalid", "ignored")
