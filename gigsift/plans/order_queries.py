"""Queries over orders as listings: scoring, gates, views, metrics, rendering; each with its SQL counterpart.

The SQL knows the nine titles and five briefs only by facts read off the rules by hand (keyword groups, stack level,
intent and so on); everything numeric is computed independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import format_budget
from ..functions.values import age_hours
from ..operators import deliver, metrics, outbox, render, score, views
from ..operators.normalize import with_identity
from ..rules import Profile
from ..session import checkpoint
from ..sources.scan import as_json
from .views import NOW, assessed_orders, order_candidates, order_listings, view

LISTING = """
counts AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
base AS (
  SELECT o_orderkey AS k, o_custkey % 5 AS s, o_orderkey % 9 AS t, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS d,
         o_orderstatus AS st, n, o_custkey % 5 = 3 AS post, CASE WHEN o_orderkey % 17 <> 0 THEN
           CAST(floor(o_totalprice / CASE WHEN o_orderkey % 7 = 0 THEN 2.0::DOUBLE WHEN o_orderkey % 11 = 0 THEN 100.0::DOUBLE ELSE 10.0::DOUBLE END) AS BIGINT) END AS bmax
  FROM orders LEFT JOIN counts ON l_orderkey = o_orderkey),
listing AS (
  SELECT k, t, d, post, bmax,
    CASE s WHEN 0 THEN 'freelance_ru' WHEN 1 THEN 'habr_freelance' WHEN 2 THEN 'fl_ru' WHEN 3 THEN 'telegram_public' ELSE 'weblancer' END AS source,
    CASE WHEN post THEN 'orders_feed_' || k ELSE CAST(k AS VARCHAR) END AS source_id,
    CASE WHEN k % 5 = 0 THEN bmax // 2 END AS bmin, CASE WHEN k % 23 = 0 THEN 'USD' ELSE 'RUB' END AS currency,
    CASE WHEN k % 13 <> 0 THEN CAST(n * 3 - 3 AS INTEGER) END AS responses,
    CASE WHEN k % 19 <> 0 THEN (((k % 30) - 1) * 60 + (k % 4) * 15) / 60.0::DOUBLE END AS age,
    k % 31 <> 0 AS confirmed_flag, k % 31 <> 0 AND k % 37 <> 0 AS confirmed, post AND k % 9 = 0 AS education, k % 6 = 0 AS programming_category,
    CASE st WHEN 'P' THEN 'open' WHEN 'O' THEN 'unknown' ELSE 'closed' END AS status, k % 29 <> 0 AS has_evidence,
    NOT post OR k % 3 = 0 AS has_card
  FROM base),
facts AS (
  SELECT *, source || ':' || source_id AS key,
    -- keyword groups: 1 bots, 2 python, 4 api, 8 automation, 16 parsing, 32 web, 64 1C, 128 infrastructure, 256 sql
    bit_count((CASE t WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 16 WHEN 3 THEN 32 WHEN 4 THEN 68 WHEN 7 THEN 32 ELSE 0 END)
              | (CASE d WHEN 1 THEN 258 WHEN 2 THEN 4 WHEN 5 THEN 130 ELSE 0 END)) AS groups,
    t IN (0, 1, 2, 3, 4, 7) OR d IN (1, 2, 5) AS has_positive, t IN (5, 6) AS has_negative,
    t IN (0, 1, 4) OR d = 2 AS body_intent, t IN (1, 4) OR d IN (2, 5) AS special,
    CASE WHEN t = 7 THEN 'LOW_UNKNOWN_MATCH' WHEN t IN (3, 4) THEN 'PARTIAL_MATCH' WHEN t IN (0, 1, 2) OR d IN (1, 2) THEN 'HIGH_MATCH'
         ELSE 'LOW_UNKNOWN_MATCH' END AS level,
    t IN (0, 3) OR d = 2 AS existing, d IN (1, 2) AS concrete, CASE d WHEN 1 THEN 3 WHEN 2 THEN 15 END AS days,
    d = 3 AS large_text, d = 3 AS experience,
    coalesce(bmax, bmin) AS amount
  FROM listing),
judged AS (
  SELECT *, has_negative AND NOT body_intent AS manual, has_positive OR programming_category AS programming,
    CASE WHEN currency = 'RUB' THEN amount END AS rub,
    CASE WHEN age BETWEEN 0 AND 24 THEN CASE WHEN age <= 2 THEN 3 WHEN age <= 6 THEN 2 WHEN age <= 12 THEN 1 ELSE 0 END END AS p_fresh,
    CASE level WHEN 'HIGH_MATCH' THEN 2 WHEN 'PARTIAL_MATCH' THEN 0 ELSE -3 END AS p_stack,
    CASE WHEN responses <= 3 THEN 3 WHEN responses <= 7 THEN 2 WHEN responses <= 15 THEN 1 WHEN responses <= 20 THEN -1
         WHEN responses <= 30 THEN -3 WHEN responses > 30 THEN -5 END AS p_competition,
    status = 'open' AND has_evidence AS open_confirmed, status = 'closed' AS closed
  FROM facts),
graded AS (
  SELECT *, education OR manual OR NOT programming AS skipped, level = 'LOW_UNKNOWN_MATCH' AS mismatch,
    CASE WHEN rub < 3000 THEN 0 WHEN rub < 5000 THEN -2 WHEN rub <= 30000 THEN 2 WHEN rub <= 100000 THEN 1 ELSE 0 END AS p_budget,
    coalesce(rub > 100000, false) AS large_budget, coalesce(rub > 100000, false) OR large_text AS large,
    confirmed AND has_card AND NOT closed AND p_fresh IS NOT NULL AND NOT coalesce(rub < 3000, false) AS allowed,
    status IN ('open', 'unknown') AND NOT open_confirmed AS status_unknown
  FROM judged),
pointed AS (
  SELECT *, 2 + least(4, groups + 1) + p_stack + coalesce(p_fresh, 0) + concrete::INT + p_budget + coalesce(p_competition, 0) + existing::INT
      + CASE WHEN days BETWEEN 1 AND 5 THEN 1 WHEN days > 10 AND days < 30 THEN -2 ELSE 0 END - 3 * large::INT - 3 * experience::INT AS total,
    least(10, CASE WHEN NOT allowed THEN 5 ELSE 10 END, CASE WHEN allowed AND age > 6 THEN 7 ELSE 10 END, CASE WHEN large OR experience THEN 7 ELSE 10 END,
      CASE WHEN responses IS NULL OR responses > 20 THEN 7 ELSE 10 END, CASE WHEN responses > 30 THEN 6 ELSE 10 END,
      CASE WHEN level = 'PARTIAL_MATCH' OR status_unknown THEN 7 ELSE 10 END, CASE WHEN mismatch THEN 6 ELSE 10 END) AS cap,
    3 + CASE WHEN days > 10 AND days < 30 THEN 2 ELSE 0 END + 3 * large::INT + 2 * experience::INT + special::INT AS effort
  FROM graded),
scored AS (
  SELECT *, CASE WHEN skipped THEN 0 ELSE total END AS raw_score, CASE WHEN skipped THEN 0 ELSE least(greatest(total, 0), cap) END AS score,
    CASE WHEN skipped THEN CASE WHEN t = 7 THEN 6 ELSE 0 END ELSE least(10, CASE WHEN mismatch THEN greatest(effort, 6) ELSE effort END) END AS complexity,
    NOT skipped AND coalesce(age BETWEEN 0 AND 6, false) AS hot,
    concat_ws(',', CASE WHEN mismatch THEN 'STACK_MISMATCH' END, CASE WHEN NOT skipped THEN concat_ws(',',
      CASE WHEN NOT confirmed THEN 'UNCONFIRMED_PUBLICATION' END, CASE WHEN NOT has_card THEN 'INVALID_DIRECT_URL' END,
      CASE WHEN closed THEN 'PROJECT_NOT_OPEN' END, CASE WHEN large_budget THEN 'LARGE_PROJECT' END,
      CASE WHEN responses IS NULL THEN 'RESPONSES_UNKNOWN' WHEN responses > 20 THEN 'HIGH_COMPETITION' END,
      CASE WHEN large AND NOT large_budget THEN 'LARGE_PROJECT' END, CASE WHEN experience THEN 'EXPERIENCE_GATE' END,
      CASE WHEN status_unknown THEN 'OPEN_STATUS_UNKNOWN' END, CASE WHEN allowed AND age > 6 THEN 'OLDER_THAN_HOT_WINDOW' END) END) AS flag_text
  FROM pointed),
labelled AS (
  SELECT * REPLACE (trim(flag_text, ',') AS flag_text), NOT skipped AND allowed AND score >= 6 AS eligible, k % 41 = 0 AS seen,
    CASE WHEN NOT (NOT skipped AND allowed AND score >= 6) THEN 'SKIP' WHEN score >= 8 THEN 'FIRE' ELSE 'GOOD' END AS label
  FROM scored),
final AS (
  SELECT *, concat_ws(',', CASE WHEN NOT eligible THEN 'INELIGIBLE' END, CASE WHEN score < 7 THEN 'MIN_SCORE' END, CASE WHEN mismatch THEN 'STACK_MISMATCH' END,
      CASE WHEN responses IS NULL THEN 'RESPONSES_UNKNOWN' END, CASE WHEN responses > 20 THEN 'COMPETITION' END,
      CASE WHEN responses > 50 AND NOT coalesce(level = 'HIGH_MATCH' AND currency = 'RUB' AND coalesce(bmin, bmax) >= 50000, false) THEN 'COMPETITION_OVER_50' END,
      CASE WHEN label = 'FIRE' AND (level <> 'HIGH_MATCH') THEN 'FIRE_REQUIRES_HIGH_MATCH' END,
      CASE WHEN label = 'FIRE' AND NOT open_confirmed THEN 'OPEN_STATUS_UNCONFIRMED' END,
      CASE WHEN label = 'FIRE' AND (responses IS NULL OR responses > 20) THEN 'FIRE_COMPETITION' END, CASE WHEN seen THEN 'ALREADY_SEEN' END) AS blockers,
    coalesce(confirmed_flag AND age BETWEEN 0 AND 24, false) AS fresh
  FROM labelled)
"""
TITLE = "CASE t WHEN 0 THEN 'Доработать telegram-бот на Python' WHEN 1 THEN 'Настроить REST API и webhook' WHEN 2 THEN 'Парсинг каталога в csv' " \
        "WHEN 3 THEN 'Исправить ошибку магазина WordPress' WHEN 4 THEN 'Интеграция 1С и сайта' WHEN 5 THEN 'Перевод текстов и презентации' " \
        "WHEN 6 THEN 'Логотип и дизайн' WHEN 7 THEN 'Backend на Haskell' ELSE 'Консультация по проекту' END"
ORDER = "score DESC, age ASC NULLS LAST, responses ASC NULLS LAST, key ASC"

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None, prefix: str = LISTING):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = f"WITH {prefix} {sql}" if prefix else sql
        return build
    return register


c = F.col


def codes(column: str):
    return F.array_join(F.transform(column, lambda r: r["code"]), ",")


@query("score", "SELECT k AS row_id, raw_score, score, complexity, eligible, label, level AS stack_compatibility FROM final")
def _(spark, folder) -> DataFrame:
    return view(assessed_orders, spark, folder, ()).select("row_id", "raw_score", "score", "complexity", "eligible", "label", "stack_compatibility")


@query("label", "SELECT label, score, hot, count(*) AS n, sum(complexity) AS complexity_sum FROM final GROUP BY 1, 2, 3")
def _(spark, folder):
    return view(assessed_orders, spark, folder, ()).groupBy("label", "score", "hot").agg(
        F.count(F.lit(1)).alias("n"), F.sum("complexity").alias("complexity_sum"))


@query("risk_flags", "SELECT k AS row_id, flag_text AS flags FROM final")
def _(spark, folder):
    return view(assessed_orders, spark, folder, ()).select("row_id", F.array_join("risk_flags", ",").alias("flags"))


@query("reasons", """SELECT k AS row_id, CASE WHEN education THEN 'education' WHEN manual THEN 'manual_or_nontechnical'
  WHEN NOT programming THEN 'no_technical_signal' ELSE concat_ws(',', 'base', 'specialization', 'stack_compatibility',
  CASE WHEN NOT confirmed THEN 'unconfirmed_publication' END, CASE WHEN NOT has_card THEN 'invalid_direct_url' END, CASE WHEN closed THEN 'closed_project' END,
  CASE WHEN age IS NULL THEN 'unknown_date' WHEN age < 0 THEN 'future_date' WHEN age > 24 THEN 'stale' ELSE 'fresh' END,
  CASE WHEN concrete THEN 'concrete' END,
  CASE WHEN amount IS NULL THEN 'unknown_budget' WHEN currency <> 'RUB' THEN 'foreign_budget' WHEN amount < 3000 THEN 'budget_too_low' ELSE 'budget' END,
  CASE WHEN responses IS NULL THEN 'unknown_responses' ELSE 'competition' END, CASE WHEN existing THEN 'existing' END,
  CASE WHEN days BETWEEN 1 AND 5 THEN 'short_task' WHEN days BETWEEN 11 AND 29 THEN 'long_task' END,
  CASE WHEN large THEN 'large_project' END, CASE WHEN experience THEN 'experience_gate' END, CASE WHEN NOT allowed THEN 'hard_skip' END,
  CASE WHEN allowed AND age > 6 THEN 'fire_age_limit' END, CASE WHEN large OR experience THEN 'fire_blocked' END,
  CASE WHEN responses IS NULL OR responses > 20 THEN 'competition_cap' END, CASE WHEN level = 'PARTIAL_MATCH' THEN 'partial_stack_cap' END,
  CASE WHEN status_unknown THEN 'open_status_cap' END, CASE WHEN mismatch THEN 'stack_score_cap' END) END AS codes,
  raw_score AS points FROM final""")
def _(spark, folder):
    total = F.aggregate("reasons", F.lit(0), lambda n, r: n + r["points"])
    return view(assessed_orders, spark, folder, ()).select("row_id", codes("reasons").alias("codes"), total.alias("points"))


@query("specialization", "SELECT k AS row_id, groups, least(4, groups + 1) AS points FROM final WHERE NOT skipped")
def _(spark, folder):
    rows = view(assessed_orders, spark, folder).filter("scored")
    groups = score.specialization_groups(c("positive_keywords"), Profile().groups)
    return rows.select("row_id", groups.alias("groups"), F.least(F.lit(4), groups + 1).alias("points"))


@query("hard_gates", """SELECT k AS row_id, concat_ws(',', CASE WHEN NOT confirmed THEN 'unconfirmed_publication' END, CASE WHEN NOT has_card THEN 'invalid_direct_url' END,
  CASE WHEN closed THEN 'closed_project' END, CASE WHEN age IS NULL THEN 'unknown_date' WHEN age < 0 THEN 'future_date' WHEN age > 24 THEN 'stale' END,
  CASE WHEN coalesce(rub < 3000, false) THEN 'budget_too_low' END) AS gates FROM final WHERE NOT skipped""")
def _(spark, folder):
    hard = ("unconfirmed_publication", "invalid_direct_url", "closed_project", "unknown_date", "future_date", "stale", "budget_too_low")
    shut = F.filter("reasons", lambda r: r["code"].isin(*hard))
    return view(assessed_orders, spark, folder).filter("scored").select("row_id", F.array_join(F.transform(shut, lambda r: r["code"]), ",").alias("gates"))


@query("freshness", "SELECT k AS row_id, p_fresh AS points FROM final")
def _(spark, folder):
    age = age_hours(c("published_at"), score.moment(NOW))
    return view(order_listings, spark, folder).select("row_id", F.when(age.between(0, 24), score.freshness_points(age)).alias("points"))


@query("age_hours", "SELECT k AS row_id, round(age, 6) AS age_hours FROM final")
def _(spark, folder):
    return view(order_listings, spark, folder).select("row_id", F.round(age_hours(c("published_at"), score.moment(NOW)), 6).alias("age_hours"))


@query("fresh", "SELECT k AS row_id, fresh FROM final")
def _(spark, folder):
    age = age_hours(c("published_at"), score.moment(NOW))
    return view(order_listings, spark, folder).select("row_id", score.is_fresh(c("publication_confirmed"), age, 24).alias("fresh"))


@query("late_rows", "SELECT CASE WHEN age < 0 THEN 'future' WHEN age > 24 THEN 'late' END AS lateness, label, count(*) AS n FROM final WHERE age < 0 OR age > 24 GROUP BY 1, 2")
def _(spark, folder):
    late = view(assessed_orders, spark, folder).filter("age_hours < 0 OR age_hours > 24")
    return late.groupBy(F.when(c("age_hours") < 0, "future").otherwise("late").alias("lateness"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("open_confirmed", "SELECT k AS row_id, open_confirmed FROM final")
def _(spark, folder):
    return view(order_listings, spark, folder).select("row_id", score.open_confirmed(c("open_status"), c("status_evidence")).alias("open_confirmed"))


@query("budget_points", """SELECT k AS row_id, CASE WHEN amount IS NULL THEN 'unknown_budget' WHEN currency <> 'RUB' THEN 'foreign_budget'
  WHEN amount < 3000 THEN 'budget_too_low' ELSE 'budget' END AS code, p_budget AS points FROM final""")
def _(spark, folder):
    code, points, _text = score.budget_rule(F.coalesce("budget_max", "budget_min"), c("currency"))
    return view(order_listings, spark, folder).select("row_id", code.alias("code"), points.alias("points"))


@query("competition", "SELECT k AS row_id, responses, p_competition AS points FROM final")
def _(spark, folder):
    return view(order_listings, spark, folder).select("row_id", c("responses_count").alias("responses"), score.competition_points(c("responses_count")).alias("points"))


@query("concrete", "SELECT k AS row_id, concrete FROM final WHERE NOT skipped")
def _(spark, folder):
    found = F.exists("reasons", lambda r: r["code"] == "concrete")
    return view(assessed_orders, spark, folder).filter("scored").select("row_id", found.alias("concrete"))


@query("duration_points", """SELECT k AS row_id, CASE WHEN days BETWEEN 1 AND 5 THEN 1 WHEN days BETWEEN 11 AND 29 THEN -2 ELSE 0 END
  - 3 * large::INT - 3 * experience::INT + existing::INT AS points FROM final WHERE NOT skipped""")
def _(spark, folder):
    wanted = F.filter("reasons", lambda r: r["code"].isin("existing", "short_task", "long_task", "large_project", "experience_gate"))
    return view(assessed_orders, spark, folder).filter("scored").select("row_id", F.aggregate(wanted, F.lit(0), lambda n, r: n + r["points"]).alias("points"))


@query("complexity", "SELECT complexity, level AS stack_compatibility, count(*) AS n FROM final GROUP BY 1, 2")
def _(spark, folder):
    return view(assessed_orders, spark, folder, ()).groupBy("complexity", "stack_compatibility").agg(F.count(F.lit(1)).alias("n"))


@query("direct_card", """SELECT k AS row_id, CASE source WHEN 'freelance_ru' THEN 'https://freelance.ru/task/view/' || k WHEN 'habr_freelance' THEN 'https://freelance.habr.com/tasks/' || k
  WHEN 'fl_ru' THEN 'https://www.fl.ru/projects/' || k || '/order.html' WHEN 'weblancer' THEN 'https://www.weblancer.net/freelance/orders-1/order-' || k
  ELSE CASE WHEN k % 3 = 0 THEN 'https://freelance.ru/task/view/' || k END END AS direct_url FROM final""")
def _(spark, folder):
    return with_identity(view(order_listings, spark, folder)).select("row_id", "direct_url")


@query("delivery_gate", "SELECT k AS row_id, blockers, eligible AND blockers = '' AS deliverable FROM final")
def _(spark, folder):
    return view(order_candidates, spark, folder).select("row_id", F.array_join("delivery_blockers", ",").alias("blockers"), "deliverable")


@query("recheck", """SELECT k AS row_id, label AS label_before, blockers = '' AND eligible AS deliverable_before,
    CASE WHEN NOT skipped AND (confirmed AND has_card AND NOT closed AND later BETWEEN 0 AND 24 AND NOT coalesce(rub < 3000, false)) THEN 'in' ELSE 'out' END AS window_later
  FROM (SELECT *, age + 3 AS later FROM final)""")
def _(spark, folder):
    """The verdict before is carried through the second assessment, so that each is made once for a row; both are written, narrow."""
    from datetime import timedelta
    before = view(order_candidates, spark, folder).withColumns({"label_before": c("label"), "deliverable_before": c("deliverable")})
    after = deliver.apply_gate(score.assess(before, NOW + timedelta(hours=3)), Profile(), c("already_seen"))
    allowed = c("scored") & ~F.exists("reasons", lambda r: r["code"] == "hard_skip")
    both = checkpoint(after.select("row_id", "label_before", "deliverable_before", F.when(allowed, "in").otherwise("out").alias("window_later")))
    return both.select("row_id", "label_before", "deliverable_before").join(both.select("row_id", "window_later"), "row_id")


@query("source_metrics", """SELECT r.source, r.ord AS source_ord, CASE WHEN r.source = 'weblancer' THEN 'disabled' ELSE 'ok' END AS status,
    CASE WHEN r.source = 'weblancer' THEN 0 ELSE coalesce(f, 0) END AS fetched, CASE WHEN r.source = 'weblancer' THEN 0 ELSE coalesce(fr, 0) END AS fresh_count,
    CASE WHEN r.source = 'weblancer' THEN 0 ELSE coalesce(re, 0) END AS relevant_count, CASE WHEN r.source = 'weblancer' THEN 0 ELSE coalesce(el, 0) END AS eligible_count
  FROM (VALUES ('freelance_ru', 0), ('habr_freelance', 1), ('fl_ru', 2), ('telegram_public', 3), ('weblancer', 4)) r(source, ord)
  LEFT JOIN (SELECT source, count(*) f, count(*) FILTER (WHERE fresh) fr, count(*) FILTER (WHERE NOT skipped) re, count(*) FILTER (WHERE eligible) el
             FROM final GROUP BY 1) m ON m.source = r.source""")
def _(spark, folder):
    log = view(order_listings, spark, folder).groupBy("source").agg(F.lit(1).cast("bigint").alias("seq")).select(
        "source", "seq", F.lit("orders").alias("url"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("parse_errors"), F.lit(0).alias("filtered_count"))
    found = metrics.source_metrics(metrics.source_registry(spark), log, view(assessed_orders, spark, folder, ()))
    return found.select("source", "source_ord", "status", "fetched", "fresh_count", "relevant_count", "eligible_count")


@query("source_registry", """SELECT r.source, r.ord AS source_ord, r.source <> 'weblancer' AS enabled, CASE WHEN r.source <> 'weblancer' THEN coalesce(n, 0) ELSE 0 END AS n
  FROM (VALUES ('freelance_ru', 0), ('habr_freelance', 1), ('fl_ru', 2), ('telegram_public', 3), ('weblancer', 4)) r(source, ord)
  LEFT JOIN (SELECT source, count(*) n FROM listing GROUP BY 1) m ON m.source = r.source""")
def _(spark, folder):
    counts = view(order_listings, spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    registry = metrics.source_registry(spark)
    return registry.join(counts, "source", "left").select("source", "source_ord", "enabled", F.when(c("enabled"), F.coalesce("n", F.lit(0))).otherwise(0).alias("n"))


@query("run_summary", """SELECT count(*) AS "unique", count(*) FILTER (WHERE fresh) AS fresh, count(*) FILTER (WHERE NOT skipped) AS relevance_pass, count(*) FILTER (WHERE eligible) AS eligible,
  count(*) FILTER (WHERE label = 'FIRE') AS fire, count(*) FILTER (WHERE label = 'GOOD') AS good, count(*) FILTER (WHERE eligible AND blockers = '') AS deliverable,
  count(*) FILTER (WHERE eligible AND regexp_matches(blockers, 'COMPETITION(,|$)|COMPETITION_OVER_50|RESPONSES_UNKNOWN') AND NOT (blockers = 'FIRE_COMPETITION')) AS filtered_by_competition,
  count(*) FILTER (WHERE eligible AND mismatch) AS filtered_by_stack,
  count(*) FILTER (WHERE eligible AND status_unknown) AS filtered_by_open_status, count(*) FILTER (WHERE seen) AS duplicates FROM final""")
def _(spark, folder):
    return metrics.run_summary(view(order_candidates, spark, folder, ()), 0).drop("total_fetched", "discovery_duplicates")


@query("run_events", """SELECT CASE WHEN r = 'weblancer' THEN 'source_disabled' ELSE 'source_ok' END AS event, r AS source, CASE WHEN r = 'weblancer' THEN 0 ELSE coalesce(n, 0) END AS fetched
  FROM (VALUES ('freelance_ru'), ('habr_freelance'), ('fl_ru'), ('telegram_public'), ('weblancer')) v(r) LEFT JOIN (SELECT source, count(*) n FROM listing GROUP BY 1) m ON m.source = r""")
def _(spark, folder):
    log = view(order_listings, spark, folder).groupBy("source").agg(F.lit(1).cast("bigint").alias("seq")).select(
        "source", "seq", F.lit("orders").alias("url"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("parse_errors"), F.lit(0).alias("filtered_count"))
    events = metrics.run_events(metrics.source_metrics(metrics.source_registry(spark), log, view(assessed_orders, spark, folder, ())), NOW)
    return events.select("event", "source", F.get_json_object("fields", "$.fetched").cast("bigint").alias("fetched"))


@query("candidate_rank", f"SELECT k AS row_id, row_number() OVER (ORDER BY {ORDER}) AS rank FROM final")
def _(spark, folder):
    keys = view(order_candidates, spark, folder, ()).select("row_id", "score", "age_hours", "responses_count", "key")
    return views.ranked(keys, views.candidate_order()).select("row_id", c("rank").cast("bigint").alias("rank"))


@query("top10", f"SELECT k AS row_id, key, score, label FROM final WHERE eligible ORDER BY {ORDER} LIMIT 10")
def _(spark, folder):
    return views.top(view(order_candidates, spark, folder, ("eligible",))).select("row_id", "key", "score", "label")


@query("watchlist", "SELECT k AS row_id, score, label FROM final WHERE (label = 'GOOD' AND score = 6) OR (NOT skipped AND mismatch)")
def _(spark, folder):
    return views.watchlist(view(order_candidates, spark, folder, ("scored", "label", "score", "risk_flags"))).select("row_id", "score", "label")


@query("default_view", f"""SELECT k AS row_id, label, score FROM final WHERE label <> 'SKIP' UNION ALL
  (SELECT k, label, score FROM final WHERE label = 'SKIP' ORDER BY {ORDER} LIMIT 5)""")
def _(spark, folder):
    rows = view(order_candidates, spark, folder).select("row_id", "label", "score", "age_hours", "responses_count", "key")
    return views.default_view(rows).select("row_id", "label", "score")


@query("top20_per_source", """SELECT source, k AS row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, age ASC NULLS LAST, k) AS rank FROM final WHERE eligible) WHERE rank <= 20""")
def _(spark, folder):
    return views.top_per_source(view(order_candidates, spark, folder, ("eligible",)).filter("eligible")).select("source", "row_id", "rank")


@query("outbox", f"""SELECT k AS row_id, key, score, label FROM final WHERE eligible AND blockers = '' AND NOT seen ORDER BY {ORDER} LIMIT 10""")
def _(spark, folder):
    return outbox.plan_outbox(view(order_candidates, spark, folder), NOW).select("row_id", "key", "score", "label")


@query("to_json_rows", f"""SELECT k AS row_id, key, CASE WHEN bmax IS NOT NULL THEN bmax || '.00' END AS budget_max, score,
  CASE WHEN age IS NOT NULL THEN strftime(TIMESTAMP '2026-09-21 12:00:00' - to_minutes(CAST(((k % 30) - 1) * 60 + (k % 4) * 15 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') END AS published_at FROM final""")
def _(spark, folder):
    rows = as_json(view(order_candidates, spark, folder).select("row_id", "key", "budget_max", "score", "published_at"))
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return rows.select(field("row_id").cast("bigint").alias("row_id"), field("key").alias("key"), field("budget_max").alias("budget_max"),
                       field("score").cast("int").alias("score"), field("published_at").alias("published_at"))


MONEY = "replace(rtrim(rtrim(format('{:,.2f}', %s::DOUBLE), '0'), '.'), ',', ' ')"


@query("format_budget", f"""SELECT k AS row_id, CASE WHEN bmin IS NULL AND bmax IS NULL THEN 'не указан' WHEN bmin = bmax THEN {MONEY % 'bmin'} || ' ' || currency
  WHEN bmin IS NULL THEN 'до ' || {MONEY % 'bmax'} || ' ' || currency ELSE {MONEY % 'bmin'} || '–' || {MONEY % 'bmax'} || ' ' || currency END AS budget FROM final""")
def _(spark, folder):
    return view(order_listings, spark, folder).select("row_id", format_budget(c("budget_min"), c("budget_max"), c("currency")).alias("budget"))


@query("price_band", """SELECT k AS row_id, CASE WHEN currency = 'RUB' AND (low > high OR low > 30000 OR high < 5000)
    THEN 'Уточнить объём: бюджет не пересекается с ориентиром для этой сложности (5 000–30 000 RUB).'
    ELSE replace(CASE WHEN low = high THEN format('{:,d}', low) ELSE format('{:,d}', low) || '–' || format('{:,d}', high) END, ',', ' ')
      || ' RUB — предварительный ориентир, после уточнения ТЗ.' || CASE WHEN currency <> 'RUB' THEN ' Для бюджета в другой валюте курс не применялся.' ELSE '' END END AS price
  FROM (SELECT *, CASE WHEN currency = 'RUB' THEN greatest(lo, coalesce(bmin, lo)) ELSE lo END AS low, CASE WHEN currency = 'RUB' THEN least(hi, coalesce(bmax, hi)) ELSE hi END AS high
        FROM (SELECT *, CAST(CASE WHEN complexity <= 3 THEN 5000 WHEN complexity <= 5 THEN 10000 ELSE 20000 END AS BIGINT) AS lo,
              CAST(CASE WHEN complexity <= 3 THEN 10000 WHEN complexity <= 5 THEN 20000 ELSE 30000 END AS BIGINT) AS hi FROM final))""")
def _(spark, folder):
    return view(assessed_orders, spark, folder, ()).select("row_id", render.price_band(c("complexity"), c("budget_min"), c("budget_max"), c("currency")).alias("price"))


KIND = """CASE WHEN mismatch THEN 'clarify_stack' WHEN level = 'PARTIAL_MATCH' THEN 'partial_stack' WHEN education THEN 'python' WHEN t = 0 THEN 'telegram' WHEN t = 2 THEN 'parsing'
  WHEN t = 1 OR d = 2 THEN 'api' WHEN d = 5 THEN 'infrastructure' WHEN d = 1 THEN 'sql' ELSE 'python' END"""


@query("reply_kind", f"SELECT k AS row_id, {KIND} AS reply_kind FROM final")
def _(spark, folder):
    return view(assessed_orders, spark, folder, ()).select("row_id", render.draft_kind(c("stack_compatibility"), c("positive_keywords")).alias("reply_kind"))


@query("draft", f"""SELECT k AS row_id, reply_kind, sha256('Здравствуйте! Увидел вашу задачу «' || title || E'».\\n' || body) AS draft_hash FROM (SELECT *, CASE reply_kind
    WHEN 'clarify_stack' THEN E'Готов посмотреть текущий проект и оценить объём, но сначала хотел бы уточнить используемый стек и характер доработок.\\n\\nПришлите, пожалуйста, версии технологий, описание задачи и текущего проекта. После изучения смогу сказать, возьмусь ли за работу, и оценить срок и стоимость.'
    WHEN 'partial_stack' THEN E'Готов изучить задачу. Сначала хотел бы уточнить платформу, её версию, нужные изменения и ограничения текущего проекта.\\n\\nПо этим данным оценю объём и смогу подтвердить возможность выполнения, срок и стоимость.'
    ELSE 'Готов посмотреть проект. Работаю с ' || CASE reply_kind WHEN 'telegram' THEN 'Telegram-ботами, Python и API-интеграциями' WHEN 'parsing' THEN 'Python и сбором данных из публичных источников'
        WHEN 'api' THEN 'REST API и интеграциями сервисов' WHEN 'infrastructure' THEN 'Docker, Linux и настройкой небольших серверных приложений' WHEN 'sql' THEN 'SQL и PostgreSQL' ELSE 'Python, скриптами и обработкой данных' END
      || E'.\\n\\nЕсли пришлёте ' || CASE reply_kind WHEN 'telegram' THEN 'сценарии бота и описание текущего проекта' WHEN 'parsing' THEN 'ссылки на публичные страницы и пример нужной таблицы'
        WHEN 'api' THEN 'документацию API, пример запроса и описание нужного обмена данными' WHEN 'infrastructure' THEN 'описание окружения и ошибки без паролей и токенов'
        WHEN 'sql' THEN 'схему таблиц без персональных данных, текущий запрос и ожидаемый результат' ELSE 'пример входных данных, ожидаемый результат и текущий код, если он есть' END
      || E', оценю объём, срок и точную стоимость.\\n\\nМогу приступить в ближайшее время.' END AS body
  FROM (SELECT *, {KIND} AS reply_kind, {TITLE} AS title FROM final))""")
def _(spark, folder):
    rows = render.with_drafts(view(assessed_orders, spark, folder, ()))
    return rows.select("row_id", "reply_kind", F.sha2("draft", 256).alias("draft_hash"))


@query("render", """SELECT k AS row_id, CASE WHEN NOT has_card THEN 'missing_direct_project_url' END AS message_error,
  CASE WHEN has_card THEN (CASE WHEN score >= 8 THEN '🔥 БРАТЬ' ELSE '🟡 ПОСМОТРЕТЬ' END) || ' — ' || score || '/10' END AS heading FROM final""")
def _(spark, folder):
    rows = render.with_messages(view(assessed_orders, spark, folder))
    return rows.select("row_id", "message_error", F.regexp_extract("message", r"\A<b>(.*)</b>", 1).alias("heading"))


@query("keyword_hits", """SELECT k AS row_id, array_to_string(list_transform(list_sort(list_distinct(list_concat(
    CASE t WHEN 0 THEN ['02telegram-бот', '03бот', '05python'] WHEN 1 THEN ['09api', '10rest api', '11webhook'] WHEN 2 THEN ['16парсинг'] WHEN 3 THEN ['25ошибка']
      WHEN 4 THEN ['26интеграция', '27с'] WHEN 7 THEN ['33backend'] ELSE CAST([] AS VARCHAR[]) END,
    CASE d WHEN 1 THEN ['05python', '37postgresql'] WHEN 2 THEN ['09api'] WHEN 5 THEN ['05python', '29docker'] ELSE CAST([] AS VARCHAR[]) END))),
    lambda x: CASE WHEN x = '27с' THEN '1с' ELSE substr(x, 3) END), ',') AS positive,
  CASE t WHEN 5 THEN 'презентации,перевод,тексты' WHEN 6 THEN 'дизайн,логотип' ELSE '' END AS negative FROM listing WHERE NOT education""")
def _(spark, folder):
    rows = view(assessed_orders, spark, folder, ()).filter("discovery_skip_reason IS NULL")
    return rows.select("row_id", F.array_join("positive_keywords", ",").alias("positive"), F.array_join("negative_keywords", ",").alias("negative"))


@query("stack_match", """SELECT k AS row_id, level AS stack_compatibility, concat_ws(', ', CASE WHEN t = 7 THEN 'Haskell' END, CASE t WHEN 3 THEN 'WordPress' WHEN 4 THEN '1C integration / exchange / simple extension' END,
    CASE WHEN t = 0 OR d = 1 THEN 'Python' END, CASE WHEN t = 0 THEN 'Telegram Bot API' END, CASE WHEN t = 1 OR d = 2 THEN 'REST API' END, CASE WHEN t = 1 THEN 'webhooks' END,
    CASE WHEN t = 2 THEN 'parsing/scraping' END, CASE WHEN d = 1 THEN 'SQL/PostgreSQL' END) AS stack_details FROM final""")
def _(spark, folder):
    return view(assessed_orders, spark, folder, ()).select("row_id", "stack_compatibility", F.array_join("stack_details", ", ").alias("stack_details"))
