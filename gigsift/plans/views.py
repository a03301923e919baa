"""Listings, pages and logs derived from the star-schema and corpus tables, for queries over them."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.deliver import GATED, apply_gate
from ..operators.normalize import with_identity
from ..operators.score import FILTERED, assess
from ..rules import Profile
from ..schema import conform
from ..session import spread, table
from ..functions.text import squeeze

NOW = datetime(2026, 9, 21, 12, tzinfo=timezone.utc)

ORDER_SOURCES = ("freelance_ru", "habr_freelance", "fl_ru", "telegram_public", "weblancer")
ORDER_TITLES = (
    "Доработать telegram-бот на Python", "Настроить REST API и webhook", "Парсинг каталога в csv",
    "Исправить ошибку магазина WordPress", "Интеграция 1С и сайта", "Перевод текстов и презентации",
    "Логотип и дизайн", "Backend на Haskell", "Консультация по проекту",
)
ORDER_BRIEFS = (
    "Добавить команды, сохранить данные в csv и json. Стек: Python, PostgreSQL. Срок: 3 дня, код и доступы готовы к передаче.",
    "Срок 12-15 дней, доработка существующего api, нужна настройка сервера и выгрузка отчётов в xlsx по расписанию.",
    "Маркетплейс с нуля, требуется опыт от 5 лет и портфолио.",
    None,
    "Простая задача, Docker не требуется, без Python.",
)

# rules for the synthetic prose of `documents`: frequent words of its languages
DOC_PROFILE = Profile(
    positive_terms=("the", "that", "que", "der", "la", "and", "una", "ist"),
    negative_terms=("une", "los", "von", "by"),
    term_patterns={"that": r"that|this", "que": r"qu\w*", "by": r"by\s+\w+"},
    intent=r"\b(?:the|le|el|die)\s+(?:\w+\s+){0,2}(?:of|de|in|to)\b",
    technical_category=r"\b(?:en|es)\b",
    software_product=r"\b(?:is|est|es)\b",
    manual_action=r"\b(?:une|by)\s.{0,45}(?:le|the)",
    groups=(("the", "that"), ("que", "la", "una"), ("der", "ist"), ("and",)),
    stack_high={"with": r"with", "for": r"for|pour", "les": r"les"},
    stack_partial={"was": r"was|were", "por": r"por|para"},
    stack_low={"not": r"not|nicht", "su": r"su"},
    post_advertisement=r"was\s+the|by\s+the\b", post_education=r"(?:of|de).{0,20}(?:une|are)\b",
    post_full_time=r"\bthat\b|/mes\b", post_project_work=r"\bfor\b",
)


def pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


@lru_cache(maxsize=64)
def _cached(build, application: str, spark: SparkSession, folder: str, *fixed) -> DataFrame:
    return build(spark, folder, *fixed)


def view(build, spark: SparkSession, folder: str, *fixed) -> DataFrame:
    """A view's plan, built once per application. Only the plan is kept, never its rows."""
    return _cached(build, spark.sparkContext.applicationId, spark, folder, *fixed)


def order_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as listings: line items are responses, the priority picks a brief, the key the rest."""
    c, k = F.col, F.col("o_orderkey")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, folder, "orders").join(lines, k == c("l_orderkey"), "left")
    source = pick(c("o_custkey") % 5 + 1, ORDER_SOURCES)
    post = c("o_custkey") % 5 == 3
    number = k.cast("string")
    url = (F.when(source == "freelance_ru", F.concat(F.lit("https://freelance.ru/task/view/"), number))
           .when(source == "habr_freelance", F.concat(F.lit("https://freelance.habr.com/tasks/"), number))
           .when(source == "fl_ru", F.concat(F.lit("https://www.fl.ru/projects/"), number, F.lit("/order.html")))
           .when(post, F.concat(F.lit("https://t.me/orders_feed/"), number))
           .otherwise(F.concat(F.lit("https://www.weblancer.net/freelance/orders-1/order-"), number)))
    linked = post & (k % 3 == 0)
    divisor = F.when(k % 7 == 0, 2.0).when(k % 11 == 0, 100.0).otherwise(10.0)
    ceiling = F.when(k % 17 != 0, F.floor(c("o_totalprice") / divisor))
    minutes = ((k % 30) - 1) * 60 + (k % 4) * 15
    status = F.when(c("o_orderstatus") == "P", "open").when(c("o_orderstatus") == "O", "unknown").otherwise("closed")
    return conform(rows.select(
        k.alias("row_id"), source.alias("source"), F.when(post, F.concat(F.lit("orders_feed_"), number)).otherwise(number).alias("source_id"),
        pick(k % 9 + 1, ORDER_TITLES).alias("title"), url.alias("url"),
        pick(F.substring("o_orderpriority", 1, 1).cast("int"), ORDER_BRIEFS).alias("description"),
        F.when(k % 6 == 0, "Программирование").alias("category"),
        F.when(k % 19 != 0, F.timestamp_micros(F.unix_micros(F.lit(NOW)) - minutes * 60_000_000)).alias("published_at"),
        F.when(k % 5 == 0, F.floor(ceiling / 2)).alias("budget_min"), ceiling.alias("budget_max"),
        F.when(k % 23 == 0, "USD").otherwise("RUB").alias("currency"), F.when(k % 13 != 0, c("n") * 3 - 3).alias("responses_count"),
        F.when(post, "orders_feed").alias("channel"), F.when(linked, F.concat(F.lit("https://freelance.ru/task/view/"), number)).alias("external_url"),
        F.when(linked, "repost").when(post, "direct_post").otherwise("marketplace").alias("origin_kind"),
        F.when(post & (k % 9 == 0), "education").alias("discovery_skip_reason"), (k % 31 != 0).alias("publication_confirmed"),
        F.when(k % 37 != 0, "order record").alias("publication_evidence"), status.alias("open_status"),
        F.when(k % 29 != 0, F.concat(F.lit("status "), c("o_orderstatus"))).alias("status_evidence")))


def assessed_orders(spark: SparkSession, folder: str, fixed: tuple[str, ...] = FILTERED) -> DataFrame:
    """Assessed orders; `fixed` names the assessed columns that a query filters by."""
    return assess(spread(view(order_listings, spark, folder), "row_id", table(spark, folder, "orders")), NOW, fixed=fixed)


def order_candidates(spark: SparkSession, folder: str, fixed: tuple[str, ...] = FILTERED + GATED) -> DataFrame:
    """Assessed and gated orders; every 41st order counts as delivered before. `fixed` names the columns that a query filters by."""
    seen = F.col("row_id") % 41 == 0
    rows = view(assessed_orders, spark, folder, tuple(name for name in fixed if name not in GATED))
    return apply_gate(rows.withColumn("already_seen", seen), Profile(), seen, tuple(name for name in fixed if name in GATED))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def doc_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as listings: the first line is the title, the whole text the description, the language the category.

    Every third document is a channel post and every sixth of them links to the marketplace copy of its text.
    """
    c, k = F.col, F.col("doc_id")
    first = F.substring(squeeze(F.get(F.split("text", "\n"), 0)), 1, 180)
    post = k % 3 == 0
    card = F.concat(F.lit("https://"), c("source"), F.lit(".example.com/doc/"), (c("n_chars") % 997).cast("string"), F.lit("?ref="), k.cast("string"))
    return with_identity(conform(spread(table(spark, folder, "documents"), "doc_id").select(
        k.alias("row_id"), c("source"), k.cast("string").alias("source_id"), F.coalesce(F.nullif(first, F.lit("")), F.lit("-")).alias("title"),
        F.when(post, F.concat(F.lit("https://t.me/documents/"), k.cast("string"))).otherwise(card).alias("url"), c("text").alias("description"),
        c("lang").alias("category"), F.when(post & (k % 6 == 0), card).alias("external_url"),
        F.when(post & (k % 6 == 0), "repost").when(post, "direct_post").otherwise("marketplace").alias("origin_kind"),
        F.when(k % 5 != 0, F.timestamp_micros(F.unix_micros(F.lit(NOW)) - (k % 7) * 3_600_000_000)).alias("published_at"),
        (k % 4 != 0).alias("publication_confirmed"), F.lit("document").alias("publication_evidence"),
        F.when(k % 11 == 0, "closed").when(k % 13 == 0, "awarded").otherwise("unknown").alias("open_status"),
        F.concat(F.lit("label "), k.cast("string")).alias("status_evidence"))))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as state actions: view and signup observe, click reserves, purchase confirms, error releases."""
    action = (F.when(F.col("event_type") == "click", "reserve").when(F.col("event_type") == "purchase", "sent")
              .when(F.col("event_type") == "error", "release").otherwise("observe"))
    return table(spark, folder, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), action.alias("action"))
