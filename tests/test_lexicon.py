"""Lexicons, stack lists and value columns against plain Python readings of the same rules, over mixed texts and case tables."""

import random
import re
import time
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from listing_cases import NOW
from pyspark.sql import functions as F

from gigsift import vocab
from gigsift.functions import lexicon, text, urls, values
from gigsift.operators import classify, outbox
from gigsift.rules import Profile

# one text that each pattern must find, by term or name; every other term is its own example
EXAMPLES = {
    "telegram bot": "telegram-bots", "telegram-бот": "telegram  бота", "бот": "ботами", "автоматизация": "автоматизируем", "парсер": "парсером",
    "парсинг": "парсинга", "доработать сайт": "доработаем сайты", "доработка сайта": "доработка сайта", "bug": "баги", "ошибка": "ошибки",
    "интеграция": "интеграцию", "1с": "1c:erp", "дизайн": "дизайнер", "логотип": "логотипа", "копирайтинг": "копирайтер", "тексты": "текстов",
    "отзывы": "отзыва", "карточки товаров": "карточка товара", "анкеты": "анкету", "презентации": "слайды", "photoshop": "фотошопом", "ретушь": "ретуши",
    "перевод": "перевести", "контент-менеджмент": "контент менеджер", "наполнение сайта": "заполнить сайт", "продажи": "продажам", "поиск клиентов": "найти клиентов",
    "холодные звонки": "холодных звонков", "оператор маркетплейса": "менеджер маркетплейса", "рассылка контента": "публиковать контент", "seo продвижение": "seo-продвижение",
    "Python": "питоном", "Telegram Bot API": "бота для telegram", "REST API": "rest api", "webhooks": "вебхук", "automation": "автоматизировать", "parsing/scraping": "скрейпинг",
    "JavaScript": "js", "TypeScript": "ts", "React": "reactjs", "Node.js": "node.js", "VPS": "vds", "SQL/PostgreSQL": "postgres", "PHP": "php 8.2", "WordPress": "вордпресс",
    "OpenCart": "опенкарт", "payment integrations": "платёжный шлюз", "Google APIs": "google sheets api", "Bitrix": "битрикс24", "Ruby / Ruby on Rails": "ruby on rails",
    "Java": "spring boot", "C# / .NET": "asp.net", "C++": "c++17", "Flutter": "dart", "Android": "андроида", "Tilda": "тильде", "Cleverence": "клеверенс", "GetCourse": "гет курс",
    "Go": "golang", "Windows/RDP": "rdp"}
FILLERS = ["и", "нужен", "срок 3 дня", "проект,", "готово.", "без", "не используем", "without", "опыт", "не нужен", "not required", "не требуется", "xapi", "reactor", "ботаника", "goal", "1сс"]


def found(pattern, line):
    return re.search(rf"(?<!\w)(?:{pattern})(?!\w)", line, re.I) is not None


def named(pattern, line):
    """Is there a mention that is not excluded by the words around it?"""
    for hit in re.finditer(rf"(?<!\w)(?:{pattern})(?!\w)", line, re.I):
        before = line[max(0, hit.start() - vocab.NEGATION_WIDTH_BEFORE):hit.start()]
        excluded = re.search(rf"(?:{'|'.join(vocab.NEGATORS_BEFORE)})\s*\Z", before, re.I) or (
            re.match(vocab.NEGATED_AFTER, line[hit.end():], re.I) and not re.search(rf"{vocab.EXPERIENCE_WORD}\w*\s*\Z", before, re.I))
        if not excluded:
            return True
    return False


def mixed(words, n, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choice(words) if draw.random() < 0.45 else draw.choice(FILLERS) for _ in range(draw.randrange(1, 14))) for _ in range(n)]


def test_every_term_is_found_by_its_pattern_and_nowhere_else(spark):
    terms = (*vocab.POSITIVE_TERMS, *vocab.NEGATIVE_TERMS)
    pattern = lambda term: vocab.TERM_PATTERNS.get(term, re.escape(term))
    samples = [EXAMPLES[term] if term in vocab.TERM_PATTERNS else term for term in terms]
    assert all(found(pattern(term), sample) for term, sample in zip(terms, samples))
    lines = samples + mixed(samples, 400, 1) + [s.upper() for s in samples] + [f"x{s}" for s in samples] + [f"{s}x" for s in samples]
    table = spark.createDataFrame(list(enumerate(lines)), "id int, line string").withColumns({"t": F.lower("line")}).withColumn("f", lexicon.searchable(F.col("t")))
    rows = table.select("id", lexicon.matched_terms("t", "f", terms, vocab.TERM_PATTERNS).alias("hits")).collect()
    for row in rows:
        assert row.hits == [term for term in terms if found(pattern(term), lines[row.id].lower())], lines[row.id]


def test_stack_names_are_found_unless_they_are_excluded(spark):
    patterns = vocab.STACK_HIGH | vocab.STACK_PARTIAL | vocab.STACK_LOW
    samples = [EXAMPLES.get(name, name.lower()) for name in patterns]
    assert all(named(pattern, sample) for pattern, sample in zip(patterns.values(), samples))
    lines = samples + mixed(samples, 500, 2) + [f"без {s}" for s in samples] + [f"{s} не нужен" for s in samples] + [f"опыт {s} не требуется" for s in samples]
    table = spark.createDataFrame(list(enumerate(lines)), "id int, line string").withColumn("f", lexicon.searchable(F.col("line")))
    for row in table.select("id", lexicon.mentioned_names("line", "f", patterns).alias("hits")).collect():
        assert row.hits == [name for name, pattern in patterns.items() if named(pattern, lines[row.id])], lines[row.id]


def test_stack_levels(spark, listings):
    cases = {"Сделать выгрузку на Python": "HIGH_MATCH", "Модуль Bitrix на PHP": "PARTIAL_MATCH", "Приложение на Kotlin и Python": "LOW_UNKNOWN_MATCH", "Полить цветы": "LOW_UNKNOWN_MATCH",
             "Стек: Python, Haskell": "LOW_UNKNOWN_MATCH", "Стек: Python, React. Without Java": "HIGH_MATCH", "Требуется Erlang": "LOW_UNKNOWN_MATCH", "Обмен 1С с сайтом через API": "PARTIAL_MATCH"}
    rows = classify.stack_compatibility(listings(*[{"title": title, "description": None} for title in cases])).select("row_id", "stack").collect()
    assert {title: row.stack.level for title, row in zip(cases, sorted(rows))} == cases
    deep = classify.stack_compatibility(listings({"title": "1С: перенос полной конфигурации", "description": None}, {"title": "1С: обмен заказами", "description": None}))
    assert [r.stack.deep_1c for r in sorted(deep.select("row_id", "stack").collect())] == [True, False]


def test_relevance_gate(listings):
    cases = {"Исправить баг в сервисе заявок": "technical_relevance", "Написать отзывы для магазина": "manual_or_nontechnical", "Нарисовать открытку": "no_technical_signal",
             "Автоматизировать отчёты в Excel": "technical_relevance", "Разработать CRM для склада": "technical_relevance", "Перевести тексты с вычиткой": "manual_or_nontechnical",
             "Настроить API и сделать дизайн": "technical_relevance"}
    rows = classify.relevance(listings(*[{"title": title, "description": None} for title in cases])).select("row_id", "relevance").collect()
    assert {title: row.relevance.code for title, row in zip(cases, sorted(rows))} == cases


def test_experience_in_time_linear_in_the_mentions(spark):
    """Thousands of mentions in a text, each judged by what stands around it: read once, not once per mention."""
    many = "проекту 4 года, сайт работает давно и без перерывов, команда большая; " * 3000
    cases = {many: False, many + "опыт от 5 лет": True, many + "опыт 2 года": False, "опыт 😀" + "x" * 38 + " 4 года": True, "опыт 😀" + "x" * 39 + " 4 года": False,
             "4 года 5 лет опыт": True, "4 года" + "x" * 9 + " 6 years опыт": True}
    table = spark.createDataFrame([(t,) for t in cases], "t string")
    began = time.monotonic()
    found = {r.t: r.need for r in table.select("t", lexicon.experience_required(F.col("t")).alias("need")).collect()}
    assert found == cases and time.monotonic() - began < 60


def test_experience(spark):
    cases = {"опыт от 3 лет": True, "опыт от 2 лет": False, "требуется 1-2 года опыта": False, "нужны кейсы обязательно": True, "опыт не требуется, 5 лет на рынке": False, "5+ лет": True,
             "компании 7 лет": False, "только senior": True, "experience 4 years required": True, "проекту год": False, "подтверждённые внедрения": True}
    table = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.need for r in table.select("t", lexicon.experience_required(F.col("t")).alias("need")).collect()} == cases


def column(spark, cases, build):
    table = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    return [r.v for r in sorted(table.select("i", build(F.col("t")).alias("v")).collect())]


def test_budgets(spark):
    cases = {"15 000 руб.": (15000, 15000, "RUB"), "от 7 000 ₽": (7000, None, "RUB"), "до 500 $": (None, 500, "USD"), "10 000 – 20 000 руб": (10000, 20000, "RUB"), "20 000-10 000 rub": (10000, 20000, "RUB"),
             "25 тыс руб": (25000, 25000, "RUB"), "1500 руб/час": (None, None, None), "по договорённости": (None, None, None), "1 234,50 €": (Decimal("1234.50"), Decimal("1234.50"), "EUR"),
             "3.500 грн": (3500, 3500, "UAH"), "сто рублей": (None, None, "RUB"), "100": (None, None, None), "": (None, None, None)}
    for (line, expected), got in zip(cases.items(), column(spark, cases, values.parse_budget)):
        assert (got.low, got.high, got.currency) == tuple(expected), line


def test_counts_statuses_and_days(spark):
    assert column(spark, ["3 ответа", "1 204", "нет", "12", "5 из 7"], values.parse_count) == [3, 1204, None, 12, None]
    labels = {"Исполнитель выбран": "awarded", "ПРОЕКТ УЖЕ ЗАКРЫТ.": "closed", "Приём заявок завершён": "not_accepting", "заказ не закрыт ли": None, "Завершено!": "closed", "открыт": None}
    assert column(spark, labels, values.closed_status) == list(labels.values())
    days = {"срок: 5 дней": 5, "за 2–4 дня": 4, "до 30 рабочих дней": 30, "3 недели": None}
    assert column(spark, days, values.duration_days) == list(days.values())


def test_dates(spark):
    local = timezone(timedelta(hours=3))
    at = lambda *parts, zone=local: datetime(*parts, tzinfo=zone).astimezone(timezone.utc).replace(tzinfo=None)
    now = NOW.replace(tzinfo=None)
    cases = {"2026-09-20": at(2026, 9, 20), "2026-09-20T10:30:00Z": at(2026, 9, 20, 10, 30, zone=timezone.utc), "2026-09-20 10:30+0500": at(2026, 9, 20, 5, 30, zone=timezone.utc),
             "05.09.2026 8:15": at(2026, 9, 5, 8, 15), "31.02.2026": None, "3 часа назад": now - timedelta(hours=3), "минуту назад": now - timedelta(minutes=1), "2 дня назад": now - timedelta(days=2),
             "сегодня в 9:05": at(2026, 9, 21, 9, 5), "вчера": at(2026, 9, 20), "сегодня 25:00": None, "только что": now, "когда-нибудь": None}
    got = column(spark, cases, lambda t: values.parse_date(t, F.lit(NOW)))
    assert got == list(cases.values())
    precise = {"1 час 20 минут назад": now - timedelta(hours=1, minutes=20), "2 дня назад": None, "вчера": None, "вчера в 10:00": at(2026, 9, 20, 10)}
    assert column(spark, precise, lambda t: values.parse_publication_time(t, F.lit(NOW))) == list(precise.values())


def test_urls(spark):
    bad = ["javascript:alert(1)", "http://user@host.example/", "https://host.example:8443/", "ftp://host.example/", "//", "https://"]
    assert all(column(spark, bad, urls.url_error))
    same = {"https://WWW.fl.ru/projects/5/name.html?utm_source=x": "https://fl.ru/projects/5", "https://host.example/a?b=2&utm_medium=q&a=1#f": "https://host.example/a?a=1&b=2",
            "https://freelance.ru/task/view/9/": "https://freelance.ru/task/view/9"}
    assert column(spark, same, urls.canonical_url) == list(same.values())


def test_post_types(spark):
    cases = {"Скидка по промокоду на всё": "advertisement", "Приглашаем на открытый вебинар": "education", "Ищем в штат, оклад высокий": "full_time_vacancy",
             "В штат не берём, разовая задача, зарплата не нужна": None, "Доработать бота": None}
    assert column(spark, cases, lambda t: values.post_skip_reason(t, Profile())) == list(cases.values())


def test_redaction_covers_the_whole_text(spark):
    line = "x " * 700 + "token 12345678:" + "A" * 30 + " at https%3A%2F%2Fhost.example/secret pw"
    got, = column(spark, [line], lambda t: text.redact(t, ("pw",)))
    assert got.endswith("token [REDACTED_TOKEN] at [REDACTED_URL] [REDACTED]") and len(got) > 1400


def test_retry_delay(spark):
    cases = {"5": 5.0, "-3": 0.0, "Mon, 21 Sep 2026 12:00:30 GMT": 30.0, "Mon, 21 Sep 2026 11:00:00 GMT": 0.0, "soon": 8.0}
    assert column(spark, cases, lambda t: outbox.retry_delay(t, F.lit(NOW), F.lit(8.0))) == list(cases.values())


def test_literals_found_in_one_pass_gate_like_the_text(spark):
    patterns = vocab.STACK_HIGH | vocab.STACK_PARTIAL | vocab.STACK_LOW
    samples = [EXAMPLES.get(name, name.lower()) for name in patterns]
    lines = samples + mixed(samples, 300, 5) + [f"x{s}" for s in samples] + ["ёpython", "(c#).net", "", "asp.net.net", "ПИТОН\nРЕСТ API", "javaſcript lınux"]
    table = spark.createDataFrame(list(enumerate(lines)), "id int, line string").withColumn("whole", lexicon.searchable(F.col("line")))
    table = table.withColumn("brief", lexicon.literals_in(F.col("whole"), patterns.values()))
    for row in table.select("brief", *[lexicon.mentioned_names("line", f, patterns).alias(f"by_{f}") for f in ("brief", "whole")]).collect():
        assert row.by_brief == row.by_whole
    few = table.select(lexicon.literals_in(F.col("whole"), ["python", "go"]).alias("few"), "whole").collect()
    assert all(row.few == row.whole for row in few)


def test_waivers_are_cut_before_experience_is_judged(spark):
    cases = {"опыт не требуется, python": False, "кейсы не нужны": False, "требуется опыт 5 лет": True, "нужен senior, портфолио обязательно": True,
             "не нужен опыт 5 лет": True, "портфолио не обязательно, опыт от 4 лет": True}
    table = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("left", lexicon.without_waivers(F.col("t")))
    asked = table.select("t", lexicon.experience_required(F.col("t")).alias("whole"), lexicon.experience_required(F.col("t"), F.col("left")).alias("given"))
    assert all(row.whole == row.given == cases[row.t] for row in asked.collect())
