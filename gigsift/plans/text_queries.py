"""Queries over documents, conversations and pages: cleaning, values in text, lexicons, URLs, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import lexicon, text as tx, urls, values
from ..functions.text import rx
from ..operators import classify, normalize, score
from ..operators.normalize import validate
from ..rules import Profile
from ..session import table
from ..sources import frontier, html, layouts
from .views import DOC_PROFILE, NOW, doc_listings, documents, view

QUERIES, ORACLE = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


W = r"[\p{L}\p{N}_]"
EDGE = (r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])")


def has(column: str, pattern: str) -> str:
    """SQL: whole-word, case-insensitive search; the SQL dialect has no look-around, so the neighbours are consumed."""
    body = pattern.replace(r"\w", W)
    return f"regexp_matches({column}, '(?i){EDGE[0]}(?:{body}){EDGE[1]}')"


def listed(conditions: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in conditions.items()) + ")"


# --- documents: cleaning and titles ----------------------------------------------------------------------------

CLEAN = r"trim(regexp_replace(regexp_replace(%s, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'))"
TITLE_SQL = r"coalesce(nullif(substr(trim(regexp_replace(split_part(text, E'\n', 1), '\s+', ' ', 'g')), 1, 180), ''), '-')"
NORM = r"trim(regexp_replace(replace(replace(lower(%s), 'ß', 'ss'), 'ё', 'е'), '[^\p{L}\p{N}_]+', ' ', 'g'))"


@query("clean_text", f"SELECT doc_id, length({CLEAN % 'text'}) AS n, sha256({CLEAN % 'text'}) AS clean_hash FROM documents")
def _(spark, folder) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", tx.clean_text(c("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("clean_hash"))


@query("norm_title", f"SELECT doc_id, {NORM % TITLE_SQL} AS norm_title FROM documents")
def _(spark, folder):
    return view(doc_listings, spark, folder).select(c("row_id").alias("doc_id"), "norm_title")


@query("first_content_line", r"""SELECT doc_id, substr(coalesce(lines[1], ''), 1, 180) AS line FROM (SELECT doc_id,
    list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_full_match(x, '(?:#[\p{L}\p{N}_]+\s*)+')) AS lines FROM documents)""")
def _(spark, folder):
    lines = layouts.content_lines(c("text"))
    return documents(spark, folder).select("doc_id", F.coalesce(layouts.first_content_line(lines), F.lit("")).alias("line"))


@query("redact", r"""SELECT doc_id, length(r) AS n, sha256(CASE WHEN r = '' THEN 'No additional network details' ELSE r END) AS redacted_sha256 FROM (SELECT doc_id,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, 'erin', '[REDACTED]'), 'https?://[^\s<>"'']+', '[REDACTED_URL]', 'gi'),
      '\d{5,20}:[A-Za-z0-9_-]{20,100}', '[REDACTED_TOKEN]', 'g'), '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS r FROM documents)""")
def _(spark, folder):
    rows = documents(spark, folder).select("doc_id", tx.redact(c("text"), ("erin",)).alias("r"))
    return rows.select("doc_id", F.length("r").cast("bigint").alias("n"), F.sha2("r", 256).alias("redacted_sha256"))


@query("fingerprint", f"""SELECT doc_id, sha256({NORM % TITLE_SQL} || E'\\n' || CASE WHEN doc_id % 3 <> 0 OR doc_id % 6 = 0
    THEN 'https://' || source || '.example.com/doc/' || (n_chars % 997) ELSE '' END) AS fingerprint FROM documents""")
def _(spark, folder):
    return view(doc_listings, spark, folder).select(c("row_id").alias("doc_id"), "fingerprint")


# --- documents: lexicons with a profile of frequent words --------------------------------------------------------

BODY = f"lower({TITLE_SQL} || ' ' || text)"
STACK = f"({TITLE_SQL} || E'\\n' || text)"
POSITIVE = {t: DOC_PROFILE.term_patterns.get(t, t) for t in DOC_PROFILE.positive_terms}
NEGATIVE = {t: DOC_PROFILE.term_patterns.get(t, t) for t in DOC_PROFILE.negative_terms}
INTENT = r"(?:the|le|el|die)\s+(?:\w+\s+){0,2}(?:of|de|in|to)"
DOC = f"d AS (SELECT doc_id, lang, {BODY} AS body, lower({TITLE_SQL}) AS title, {STACK} AS stack FROM documents)"
MATCHED = f"""{DOC}, m AS (SELECT doc_id, lang, {listed({t: has('body', p) for t, p in POSITIVE.items()})} AS positive,
  {listed({t: has('body', p) for t, p in NEGATIVE.items()})} AS negative, {has('title', INTENT)} AS title_intent, {has('body', INTENT)} AS body_intent,
  {' OR '.join(has('title', p) for p in NEGATIVE.values())} AS title_negative,
  regexp_matches(title, '(?i){EDGE[0]}(?:une|by)\\s.{{0,45}}(?:le|the)') AS title_manual, {has('title', 'is|est|es')} AS product, lang IN ('en', 'es') AS technical FROM d)"""


@query("lexicon_match", f"WITH {DOC} SELECT doc_id, {has('body', 'that|this')} AS hit FROM d")
def _(spark, folder):
    rows = view(doc_listings, spark, folder).withColumn("_body", F.lower(F.concat_ws(" ", "title", "description")))
    rows = rows.withColumn("_folded", lexicon.searchable(c("_body")))
    return rows.select(c("row_id").alias("doc_id"), lexicon.any_term("_body", "_folded", ["that"], DOC_PROFILE.term_patterns).alias("hit"))


@query("doc_keyword_hits", f"WITH {MATCHED} SELECT doc_id, positive, negative FROM m")
def _(spark, folder):
    rows = classify.relevance(view(doc_listings, spark, folder), DOC_PROFILE)
    return rows.select(c("row_id").alias("doc_id"), F.array_join("relevance.matches.positive", ",").alias("positive"),
                       F.array_join("relevance.matches.negative", ",").alias("negative"))


@query("intent_match", f"WITH {DOC} SELECT doc_id, {has('body', INTENT)} AS intent FROM d")
def _(spark, folder):
    rows = view(doc_listings, spark, folder)
    return rows.select(c("row_id").alias("doc_id"), F.lower(F.concat_ws(" ", "title", "description")).rlike(rx(DOC_PROFILE.intent)).alias("intent"))


@query("relevance_gate", f"""WITH {MATCHED}, j AS (SELECT *, NOT title_intent AND ((title_negative AND title_manual) OR (negative <> '' AND NOT body_intent)) AS manual,
    positive <> '' OR technical OR (title_intent AND product) AS programming FROM m)
  SELECT doc_id, CASE WHEN manual THEN 'manual_or_nontechnical' WHEN NOT programming THEN 'no_technical_signal' ELSE 'technical_relevance' END AS code, NOT manual AND programming AS passed FROM j""")
def _(spark, folder):
    rows = classify.relevance(view(doc_listings, spark, folder), DOC_PROFILE)
    return rows.select(c("row_id").alias("doc_id"), c("relevance.code").alias("code"), c("relevance.passed").alias("passed"))


def _stack_list(patterns) -> str:
    return listed({n: has("stack", p) for n, p in patterns.items()})


@query("stack_level", f"""WITH {DOC}, s AS (SELECT doc_id, {_stack_list(DOC_PROFILE.stack_high)} AS high, {_stack_list(DOC_PROFILE.stack_partial)} AS partial,
    {_stack_list(DOC_PROFILE.stack_low)} AS low FROM d)
  SELECT doc_id, CASE WHEN low <> '' THEN 'LOW_UNKNOWN_MATCH' WHEN partial <> '' THEN 'PARTIAL_MATCH' WHEN high <> '' THEN 'HIGH_MATCH' ELSE 'LOW_UNKNOWN_MATCH' END AS level,
    concat_ws(',', nullif(low, ''), nullif(partial, ''), nullif(high, '')) AS matches FROM s""")
def _(spark, folder):
    rows = classify.stack_compatibility(view(doc_listings, spark, folder), DOC_PROFILE)
    return rows.select(c("row_id").alias("doc_id"), c("stack.level").alias("level"), F.array_join("stack.matches", ",").alias("matches"))


@query("mention_negation", r"""SELECT doc_id, len(list_filter(t, lambda x: regexp_full_match(x, '(?i)with'))) > len(list_filter(list_zip(t, t[2:]), lambda z: lower(z[1]) = 'without' AND lower(z[2]) = 'with')) AS mentioned
  FROM (SELECT doc_id, regexp_extract_all(replace(text, ' and with ', ' without with '), '[\p{L}\p{N}_]+') AS t FROM documents)""")
def _(spark, folder):
    rows = documents(spark, folder).withColumn("_text", F.replace("text", F.lit(" and with "), F.lit(" without with ")))
    rows = rows.withColumn("_folded", lexicon.searchable(c("_text")))
    return rows.select("doc_id", lexicon.mentioned("_text", "_folded", "with").alias("mentioned"))


@query("declared_tokens", r"""SELECT doc_id, array_to_string(list_transform(flatten(list_transform(regexp_extract_all(line, 'stack:\s*([^;\n]{1,160})', 1),
    lambda d: regexp_extract_all(d, '(?:^|[^A-Za-z0-9])[A-Za-z][A-Za-z0-9]*'))), lambda t: regexp_replace(t, '^[^A-Za-z0-9]', '')), ',') AS tokens
  FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9 \n]', '', 'g'), ' (the|de|der) ', ' stack: ', 'g') AS line FROM documents)""")
def _(spark, folder):
    """Every article of the whole text declares a stack."""
    line = F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 \n]", ""), " (the|de|der) ", " stack: ")
    rows = documents(spark, folder).withColumn("_text", line)
    return rows.select("doc_id", F.array_join(lexicon.declared_tokens(c("_text"), lexicon.searchable(c("_text"))), ",").alias("tokens"))


@query("post_type", r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)was\s+the|by\s+the(?:$|[^\p{L}\p{N}_])') THEN 'advertisement' WHEN regexp_matches(t, '(?i)(?:of|de).{0,20}(?:une|are(?:$|[^\p{L}\p{N}_]))') THEN 'education'
   WHEN regexp_matches(t, '(?i)(?:^|[^\p{L}\p{N}_])that(?:$|[^\p{L}\p{N}_])|/mes') AND NOT regexp_matches(t, '(?i)(?:^|[^\p{L}\p{N}_])for(?:$|[^\p{L}\p{N}_])') THEN 'full_time_vacancy' END AS kind
  FROM (SELECT conv_id || '-' || turn AS doc_id, text AS t FROM conversations)""")
def _(spark, folder):
    rows = table(spark, folder, "conversations")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), values.post_skip_reason(c("text"), DOC_PROFILE).alias("kind"))


@query("experience", r"""SELECT doc_id, regexp_matches(replace(replace(lower(text), ' the ', ' 4 years '), ' of ', ' experience '),
    '(?s)experience[^\p{L}\p{N}_].{0,34}4 years|4 years.{0,10}experience') AS required FROM documents""")
def _(spark, folder):
    """Two common words of the whole text become years and experience."""
    note = F.replace(F.replace(F.lower("text"), F.lit(" the "), F.lit(" 4 years ")), F.lit(" of "), F.lit(" experience "))
    return documents(spark, folder).select("doc_id", lexicon.experience_required(note).alias("required"))


@query("parse_count", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(floor(o_totalprice) AS INTEGER) END AS n FROM orders""")
def _(spark, folder):
    n = F.floor("o_totalprice").cast("int")
    grouped = F.translate(F.format_number(n, 0), ",", " ")
    shown = F.when(c("o_orderkey") % 3 == 0, F.concat(grouped, F.lit(" просмотра"))).when(c("o_orderkey") % 3 == 1, n.cast("string")).otherwise(F.concat(F.lit("нет "), n))
    return table(spark, folder, "orders").select("o_orderkey", values.parse_count(shown).alias("n"))


@query("parse_budget", """SELECT o_orderkey, CASE k WHEN 1 THEN NULL WHEN 5 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN a * 1000 ELSE a END AS low,
    CASE k WHEN 0 THEN a + 500 WHEN 1 THEN a WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN a * 1000 WHEN 5 THEN NULL ELSE a END AS high,
    CASE k WHEN 1 THEN 'USD' WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 'EUR' ELSE 'RUB' END AS currency
  FROM (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(floor(o_totalprice) AS BIGINT) AS a FROM orders)""")
def _(spark, folder):
    a = F.floor("o_totalprice").cast("bigint")
    grouped = lambda v: F.translate(F.format_number(v, 0), ",", " ")
    forms = (F.concat(grouped(a), F.lit(" – "), grouped(a + 500), F.lit(" ₽ / заказ")), F.concat(F.lit("до "), a, F.lit(" $")), F.concat(F.lit("от "), grouped(a), F.lit(" руб.")),
             F.concat(a, F.lit(" ₽ / час")), F.concat(a, F.lit(" тыс руб")), F.lit("по договорённости"), F.concat(F.translate(F.format_number(a, 0), ",", "."), F.lit(" eur")))
    shown = F.element_at(F.array(*forms), (c("o_orderkey") % 7 + 1).cast("int"))
    rows = table(spark, folder, "orders").withColumn("b", values.parse_budget(shown))
    return rows.select("o_orderkey", c("b.low").cast("bigint").alias("low"), c("b.high").cast("bigint").alias("high"), c("b.currency").alias("currency"))


DATE_FORMS = "o_orderkey % 6"


@query("parse_date", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate - INTERVAL 3 HOUR WHEN 1 THEN o_orderdate - INTERVAL 3 HOUR WHEN 2 THEN o_orderdate + INTERVAL 10 HOUR
    WHEN 3 THEN TIMESTAMP '2026-09-21 12:00:00' - to_minutes(o_orderkey % 50) WHEN 4 THEN TIMESTAMP '2026-09-19 21:00:00' + to_minutes((o_orderkey % 24) * 60) END AS at FROM orders""")
def _(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", values.parse_date(_dates(), F.lit(NOW)).alias("at"))


def _dates():
    k, day = c("o_orderkey"), c("o_orderdate")
    forms = (F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd.MM.yyyy"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T12:00:00+02:00")),
             F.concat((k % 50).cast("string"), F.lit(" минут назад")), F.concat(F.lit("вчера в "), (k % 24).cast("string"), F.lit(":00")), F.lit("завтра"))
    return F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))


@query("publication_time", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN o_orderdate + INTERVAL 10 HOUR WHEN 3 THEN TIMESTAMP '2026-09-21 12:00:00' - to_minutes(o_orderkey % 50)
    WHEN 4 THEN TIMESTAMP '2026-09-19 21:00:00' + to_minutes((o_orderkey % 24) * 60) END AS at FROM orders""")
def _(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", values.parse_publication_time(_dates(), F.lit(NOW)).alias("at"))


@query("status_class", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'awarded' WHEN 1 THEN 'closed' WHEN 2 THEN 'not_accepting' END AS status FROM orders""")
def _(spark, folder):
    number = F.concat(F.lit(" "), c("o_orderkey"))
    forms = (F.lit("Исполнитель уже выбран."), F.lit("Проект закрыт"), F.lit("Приём заявок завершён!"), F.concat(F.lit("закрыт"), number), F.lit("Открыт"))
    return table(spark, folder, "orders").select("o_orderkey", values.closed_status(F.element_at(F.array(*forms), (c("o_orderkey") % 5 + 1).cast("int"))).alias("status"))


@query("duration_days", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 40 WHEN 1 THEN o_custkey % 40 + 2 END AS days FROM orders")
def _(spark, folder):
    n = c("o_custkey") % 40
    forms = (F.concat(F.lit("срок: "), n, F.lit(" рабочих дней")), F.concat(F.lit("нужно за "), n, F.lit("–"), n + 2, F.lit(" дн.")), F.concat(F.lit("примерно "), n, F.lit(" дней")))
    return table(spark, folder, "orders").select("o_orderkey", values.duration_days(F.element_at(F.array(*forms), (c("o_orderkey") % 3 + 1).cast("int"))).alias("days"))


@query("quarantine", """WITH r AS (SELECT o_orderkey AS k, floor(o_totalprice) AS p FROM orders), e AS (
    SELECT k, CASE WHEN k % 7 = 0 THEN 'invalid_source' WHEN k % 11 = 0 THEN 'invalid_source_id' WHEN k % 13 = 0 THEN 'missing_title' WHEN k % 17 = 0 THEN 'invalid_url' WHEN k % 19 = 0 THEN 'invalid_channel'
      WHEN k % 23 = 0 THEN 'invalid_origin_kind' WHEN k % 29 = 0 THEN 'invalid_discovery_skip_reason' WHEN k % 31 = 0 THEN 'invalid_open_status' WHEN k % 37 = 0 THEN 'published_at_must_include_timezone'
      WHEN k % 41 = 0 THEN 'invalid_budget' WHEN p > 400000 THEN 'invalid_budget_range' WHEN k % 43 = 0 THEN 'invalid_currency' WHEN k % 47 = 0 THEN 'invalid_count' END AS error FROM r)
  SELECT coalesce(error, 'valid') AS code, count(*) AS n FROM e GROUP BY 1""")
def _(spark, folder):
    k, price = c("o_orderkey"), F.floor("o_totalprice")
    wrong = lambda every, bad, good: F.when(k % every == 0, bad).otherwise(good)
    raw = table(spark, folder, "orders").select(
        k.alias("row_id"), wrong(7, F.lit("Bad-Source"), F.lit("orders")).alias("source"), wrong(11, F.concat(F.lit("a:"), k), k.cast("string")).alias("source_id"),
        wrong(13, F.lit(" ​ "), F.lit("Заказ")).alias("title"), wrong(17, F.lit("http://x.example/"), F.concat(F.lit("https://x.example/"), k)).alias("url"),
        wrong(19, F.lit("a b"), F.lit(None).cast("string")).alias("channel"), wrong(23, F.lit("ad"), F.lit("marketplace")).alias("origin_kind"),
        wrong(29, F.lit("spam"), F.lit(None).cast("string")).alias("discovery_skip_reason"), wrong(31, F.lit("maybe"), F.lit("open")).alias("open_status"),
        wrong(37, F.lit("2026-01-01T10:00:00"), F.lit("2026-01-01T10:00:00Z")).alias("published_at"), F.when(price > 400000, price).alias("budget_min"),
        wrong(41, F.lit(-1), F.least(price, F.lit(400000))).alias("budget_max"), wrong(43, F.lit("RU"), F.lit("rub")).alias("currency"),
        wrong(47, F.lit(-3), F.lit(3)).alias("responses_count"))
    return validate(raw).groupBy(F.coalesce(F.get("errors", 0), F.lit("valid")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


# --- pages --------------------------------------------------------------------------------------------------------

PARTS = r"""u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages)"""
SAFE = "'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END"


@query("page_scan", "SELECT page_id, url, length(html) AS n_chars, strlen(html) AS n_bytes FROM pages")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"), F.octet_length("html").cast("bigint").alias("n_bytes"))


@query("safe_url", f"WITH {PARTS} SELECT page_id, CASE WHEN scheme = 'https' THEN {SAFE} END AS url, CASE WHEN scheme <> 'https' THEN 'invalid_url' END AS error FROM u")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.safe_url(c("url")).alias("url"), urls.url_error(c("url")).alias("error"))


@query("canonical_url", rf"""WITH {PARTS} SELECT page_id, 'https://' || regexp_replace(host, '^www\.', '') || coalesce(nullif(rtrim(path, '/'), ''), '/')
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref='))), '&') AS q FROM u)""")
def _(spark, folder):
    secure = F.regexp_replace("url", "^http:", "https:")
    return table(spark, folder, "pages").select("page_id", urls.canonical_url(urls.safe_url(secure)).alias("canonical"))


@query("project_link", """SELECT page_id, page_id % 5 IN (0, 1, 2, 3) AS is_project FROM pages""")
def _(spark, folder):
    number = c("page_id").cast("string")
    forms = (F.concat(F.lit("https://www.fl.ru/projects/"), number, F.lit("/x.html?utm_source=a")), F.concat(F.lit("https://freelance.ru/task/view/"), number, F.lit("/")),
             F.concat(F.lit("https://freelance.habr.com/tasks/"), number), F.concat(F.lit("https://t.me/channel/"), number, F.lit("?single")), F.regexp_replace("url", "^http:", "https:"))
    link = F.element_at(F.array(*forms), (c("page_id") % 5 + 1).cast("int"))
    rows = table(spark, folder, "pages").select("page_id", urls.safe_url(link).alias("url")).withColumn("canonical", urls.canonical_url(c("url")))
    return rows.select("page_id", urls.is_project_link(c("canonical")).alias("is_project"))


@query("direct_url", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.fl.ru/projects/' || page_id || '/x.html' WHEN 2 THEN 'https://freelance.ru/task/view/' || page_id END AS direct_url FROM pages""")
def _(spark, folder):
    number = c("page_id").cast("string")
    own = F.concat(F.lit("https://www.fl.ru/projects/"), number, F.lit("/x.html?ref=1"))
    other = F.concat(F.lit("https://www.fl.ru/projects/9"), number, F.lit("/x.html"))
    post = F.concat(F.lit("https://t.me/channel/"), number)
    kind, pick = c("page_id") % 4, lambda *v: F.element_at(F.array(*v), (c("page_id") % 4 + 1).cast("int"))
    link = F.when(kind == 2, F.concat(F.lit("https://freelance.ru/task/view/"), number))
    listings = table(spark, folder, "pages").select(
        "page_id", F.when(kind < 2, "marketplace").otherwise("repost").alias("origin_kind"), F.when(kind < 2, "fl_ru").otherwise("telegram_public").alias("source"),
        number.alias("source_id"), pick(own, other, post, post).alias("url"), link.alias("external_url"))
    return urls.with_direct_card_url(listings).select("page_id", "direct_url")


@query("html_text", r"""SELECT page_id, sha256(t) AS text_hash, length(t) AS n FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
   regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'gs'), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gsi'), '<[^>]*>', ' ', 'g'),
   '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""")
def _(spark, folder):
    rows = html.with_page(table(spark, folder, "pages"), "page_id").select("page_id", html.tidy(c("text")).alias("t"))
    return rows.select("page_id", F.sha2("t", 256).alias("text_hash"), F.length("t").cast("bigint").alias("n"))


@query("page_title", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
   trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS heading FROM pages""")
def _(spark, folder):
    rows = html.with_page(table(spark, folder, "pages"), "page_id").withColumns({"_t": html.find(html.tag("title")), "_h": html.find(html.tag("h1"))})
    return rows.select("page_id", html.text_of(c("_t")).alias("title"), html.text_of(c("_h")).alias("heading"))


@query("page_links", r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, replace(links[i], '&amp;', '&') AS href FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i
   FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages))""")
def _(spark, folder):
    return frontier.page_links(table(spark, folder, "pages"), "page_id")


@query("page_extract", r"""SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS n_links, len(regexp_extract_all(html, '<article[ >]')) AS n_articles, len(regexp_extract_all(html, '<li[ >]')) AS n_items FROM pages""")
def _(spark, folder):
    rows = html.with_page(table(spark, folder, "pages"), "page_id")
    count = lambda test: F.size(html.find_all(test)).cast("bigint")
    return rows.select("page_id", count(html.tag("a", href=None)).alias("n_links"), count(html.tag("article")).alias("n_articles"), count(html.tag("li")).alias("n_items"))


@query("page_status", r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title>[^<]*(?:captcha|just a moment|access denied|the)') THEN 'challenge_page' WHEN regexp_matches(html, '<article[ >]') THEN 'listing' ELSE 'unrecognized_listing_layout' END AS status
  FROM pages""")
def _(spark, folder):
    rows = html.with_page(table(spark, folder, "pages"), "page_id").withColumn("_t", html.find(html.tag("title")))
    blocked = layouts.page_challenge(c("_t")) | html.text_of(c("_t")).rlike(rx("the"))
    listing = F.exists("nodes", html.tag("article"))
    return rows.select("page_id", F.when(blocked, "challenge_page").when(listing, "listing").otherwise("unrecognized_listing_layout").alias("status"))


@query("page_errors", """SELECT 'weblancer' AS source, 'all_cards_invalid' AS error, count(*) AS n FROM pages WHERE regexp_matches(html, '<article[ >]')
  UNION ALL SELECT 'weblancer', 'unrecognized_listing_layout', count(*) FROM pages WHERE NOT regexp_matches(html, '<article[ >]') HAVING count(*) > 0""")
def _(spark, folder):
    from ..operators import metrics
    rows = table(spark, folder, "pages").select(F.lit("weblancer").alias("source"), "url", F.lit(1).alias("page_no"), c("page_id").alias("seq"), "html")
    log = layouts.page_log(layouts.extract(rows, layouts.LAYOUTS["weblancer"], NOW, Profile(disabled_sources=())))
    return metrics.error_counts(log).select("source", F.explode("errors").alias("error", "n"))


@query("robots_rules", """SELECT host, CASE WHEN length(host) % 3 = 0 THEN '/private' ELSE '/en/1' END AS value, 'disallow' AS key FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)
  UNION ALL SELECT host, '/en/12', 'allow' FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) WHERE length(host) % 3 <> 0
  UNION ALL SELECT host, CAST(length(host) AS VARCHAR), 'crawl-delay' FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) WHERE length(host) % 3 <> 0
  UNION ALL SELECT host, '/*?page=', 'disallow' FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) WHERE length(host) % 3 <> 0""")
def _(spark, folder):
    return frontier.robots_rules(_robots(spark, folder), "GigSift/1.0").select("host", "value", "key")


def _robots(spark, folder) -> DataFrame:
    """A robots file for every host of the page table; hosts differ by the length of their name."""
    host = urls.url_host(c("url"))
    general = F.concat(F.lit("User-agent: *\nDisallow: /en/1\nAllow: /en/12 # kept\nCrawl-delay: "), F.length("host"), F.lit("\nDisallow: /*?page=\n"))
    own = F.lit("\nUser-agent: gigsift\nDisallow: /private\n")
    return table(spark, folder, "pages").select(host.alias("host")).distinct().select(
        "host", F.concat(general, F.when(F.length("host") % 3 == 0, own).otherwise("")).alias("text"))


@query("robots_filter", rf"""WITH {PARTS} SELECT page_id, CASE WHEN length(host) % 3 = 0 THEN true WHEN starts_with(path, '/en/12') THEN NOT (length('/?page=') > length('/en/12') AND starts_with(query, 'page='))
   WHEN starts_with(path, '/en/1') OR starts_with(query, 'page=') THEN false ELSE true END AS allowed FROM u""")
def _(spark, folder):
    rules = frontier.robots_rules(_robots(spark, folder), "GigSift/1.0")
    return frontier.robots_allowed(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "allowed")


@query("crawl_delay", """SELECT host, CAST(CASE WHEN length(host) % 3 = 0 THEN 2 ELSE greatest(2, length(host)) END AS DOUBLE) AS delay_seconds FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""")
def _(spark, folder):
    return frontier.crawl_delays(frontier.robots_rules(_robots(spark, folder), "GigSift/1.0")).select("host", "delay_seconds")


@query("dim_lookup", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Веб-программирование' WHEN 1 THEN 'Прикладное ПО' WHEN 2 THEN 'Копирайтинг' ELSE 'slug-' || (p_partkey % 10) END AS label FROM part""")
def _(spark, folder):
    slug = F.when(c("p_partkey") % 4 == 0, "veb-programmirovanie").when(c("p_partkey") % 4 == 1, "prikladnoe-po").when(c("p_partkey") % 4 == 2, "kopiraiting").otherwise(
        F.concat(F.lit("slug-"), c("p_partkey") % 10))
    return table(spark, folder, "part").select("p_partkey", layouts.category_label(slug).alias("label"))


@query("seed_frontier", """SELECT source, url, min(ord) AS ord FROM (SELECT 'freelance_ru' AS source, 'https://freelance.ru/task?q=' || replace(p_type, ' ', '+') AS url, p_partkey AS ord FROM part
  UNION ALL SELECT * FROM (VALUES ('freelance_ru', 'https://freelance.ru/task?c%5B%5D=4', -1), ('habr_freelance', 'https://freelance.habr.com/tasks', 0), ('fl_ru', 'https://www.fl.ru/projects/category/programmirovanie/', 0),
    ('fl_ru', 'https://www.fl.ru/projects/category/saity/', 1), ('fl_ru', 'https://www.fl.ru/projects/category/avtomatizaciya-biznesa/', 2), ('telegram_public', 'https://t.me/s/freelansim_ru', 0),
    ('telegram_public', 'https://t.me/s/digitaltender', 1), ('telegram_public', 'https://t.me/s/job_for_bots', 2), ('telegram_public', 'https://t.me/s/freelancetaverna', 3)) v(source, url, ord)) GROUP BY 1, 2""")
def _(spark, folder):
    terms = table(spark, folder, "part").select(c("p_partkey").alias("ord"), c("p_type").alias("term"))
    return frontier.seeds(spark, Profile(), terms)
