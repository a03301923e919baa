"""Scoring, caps, gates: boundary tables around the base listing."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from listing_cases import by_row, hours_ago
from gigsift import vocab
from gigsift.functions.urls import with_direct_card_url
from gigsift.operators import views
from gigsift.operators.deliver import apply_gate
from gigsift.operators.score import assess
from gigsift.rules import Profile, ProfileError


def run(listings, now, *changes, profile=Profile(), gate=None):
    return by_row(apply_gate(assess(listings(*changes), now, profile), gate or profile))


def points(row, code):
    return [r.points for r in row.reasons if r.code == code]


def around(*bounds):
    """Every bound and its neighbours."""
    return sorted({b + step for b in bounds for step in (-1, 0, 1)})


def first_within(value, bounds, otherwise):
    return next((points for limit, points in bounds if value <= limit), otherwise)


def test_base_listing_scores_ten_and_is_deliverable(listings, now):
    row, = run(listings, now, {})
    assert (row.score, row.label, row.eligible, row.deliverable) == (10, "FIRE", True, True)
    assert row.raw_score == sum(r.points for r in row.reasons)
    assert row.direct_url == "https://freelance.ru/task/view/5150"
    assert row.stack_compatibility == "HIGH_MATCH" and row.risk_flags == []


def test_stack_levels_and_status_cap_the_score(listings, now):
    titles = {"Починить вебхуки оплаты в сервисе на FastAPI": "HIGH_MATCH", "Исправить модуль доставки OpenCart": "PARTIAL_MATCH",
              "Исправить форму сайта на Tilda через API": "LOW_UNKNOWN_MATCH"}
    statuses = [("open", "fixture button"), ("open", None), ("unknown", "fixture button")]
    changes = [{"title": title, "open_status": status, "status_evidence": evidence} for title in titles for status, evidence in statuses]
    for row, change in zip(run(listings, now, *changes), changes):
        level = titles[change["title"]]
        known = (change["open_status"], change["status_evidence"]) == statuses[0]
        assert row.stack_compatibility == level and row.raw_score == sum(r.points for r in row.reasons)
        assert ("OPEN_STATUS_UNKNOWN" in row.risk_flags) == (not known)
        assert ("STACK_MISMATCH" in row.risk_flags) == (level == "LOW_UNKNOWN_MATCH")
        if level == "LOW_UNKNOWN_MATCH":
            assert (row.label, row.score, row.deliverable) == ("GOOD", 6, False)
        elif level == "PARTIAL_MATCH" or not known:
            assert (row.label, row.score, row.deliverable) == ("GOOD", 7, True)
        else:
            assert (row.label, row.score, row.deliverable) == ("FIRE", 10, True)


def test_freshness_steps(listings, now):
    bounds = [(2, 3), (6, 2), (12, 1), (24, 0)]
    ages = sorted({0.0, *(h + d for h, _ in bounds for d in (-0.02, 0, 0.02)), -0.5})
    rows = run(listings, now, *[{"published_at": hours_ago(age)} for age in [*ages, None]])
    for row, age in zip(rows, [*ages, None]):
        if age is None or not 0 <= age <= 24:
            assert points(row, "fresh") == [] and row.label == "SKIP" and row.score <= 5
            code = "unknown_date" if age is None else "future_date" if age < 0 else "stale"
            assert [r.code for r in row.reasons if r.code in ("stale", "future_date", "unknown_date")] == [code]
        else:
            assert points(row, "fresh") == [first_within(age, bounds, None)]
            assert row.hot == (age <= 6) and ("OLDER_THAN_HOT_WINDOW" in row.risk_flags) == (age > 6)


def test_budget_steps(listings, now):
    amounts = around(3000, 5000, 30000, 100000)
    for row, amount in zip(run(listings, now, *[{"budget_min": Decimal(a), "budget_max": Decimal(a)} for a in amounts]), amounts):
        expected = 0 if amount < 3000 else -2 if amount < 5000 else first_within(amount, [(30000, 2), (100000, 1)], 0)
        assert sum(r.points for r in row.reasons if "budget" in r.code) == expected
        assert (row.label == "SKIP") == (amount < 3000) and ("LARGE_PROJECT" in row.risk_flags) == (amount > 100000)
    unknown, = run(listings, now, {"budget_min": None, "budget_max": None})
    assert points(unknown, "unknown_budget") == [0] and unknown.eligible


def test_competition_steps(listings, now):
    counts = [n for n in around(3, 7, 15, 20, 30, 50) if n >= 0]
    for row, count in zip(run(listings, now, *[{"responses_count": n} for n in counts]), counts):
        assert points(row, "competition") == [first_within(count, [(3, 3), (7, 2), (15, 1), (20, -1), (30, -3)], -5)]
        assert row.score == first_within(count, [(20, 10), (30, 7)], 6) and row.deliverable == (count <= 20)
    unknown, = run(listings, now, {"responses_count": None})
    assert points(unknown, "competition") == [] and "RESPONSES_UNKNOWN" in unknown.delivery_blockers and not unknown.deliverable


def test_hard_gates_hold_under_relaxed_settings(listings, now):
    gates = {"unconfirmed_publication": {"publication_confirmed": False}, "closed_project": {"open_status": "awarded"},
             "unknown_date": {"published_at": None}, "budget_too_low": {"budget_min": None, "budget_max": Decimal(2500)},
             "invalid_direct_url": {"url": "https://freelance.ru/task/list"}, "stale": {"published_at": hours_ago(40)}}
    relaxed = Profile(min_score=6, max_responses=10_000, allow_stack_mismatch=True)
    for row, code in zip(run(listings, now, *gates.values(), gate=relaxed), gates):
        assert code in [r.code for r in row.reasons]
        assert row.label == "SKIP" and row.score <= 5 and not row.deliverable


def test_more_than_fifty_responses_need_a_generous_roubles_budget_and_a_high_match(listings, now):
    lows = [Decimal(n) for n in around(50_000)] + [None]
    changes = [{"budget_min": low, "budget_max": high, "currency": currency, "responses_count": 73, "title": title}
               for low in lows for high in (Decimal(64_000), None) for currency in ("RUB", "EUR")
               for title in ("Починить вебхуки оплаты в сервисе на FastAPI", "Исправить модуль доставки OpenCart")]
    strict, relaxed = run(listings, now, *changes), run(listings, now, *changes, gate=Profile(min_score=6, max_responses=100))
    for row, open_row, change in zip(strict, relaxed, changes):
        bound = change["budget_min"] if change["budget_min"] is not None else change["budget_max"]
        exception = bound is not None and bound >= 50_000 and change["currency"] == "RUB" and "FastAPI" in change["title"]
        assert "COMPETITION" in row.delivery_blockers and ("COMPETITION_OVER_50" not in row.delivery_blockers) == exception
        assert open_row.deliverable is exception


def test_duration_experience_and_size(listings, now):
    text = "Нужно исправить выгрузку отчётов в существующем сервисе на Python, доступы и описание готовы и согласованы. "
    cases = [("Срок: 3 дня", {"short_task"}, set()), ("срок 10 дней", set(), set()), ("срок 11–20 дней", {"long_task"}, set()),
             ("за 30 дней", {"large_project"}, {"LARGE_PROJECT"}), ("требуется опыт от 5 лет", {"experience_gate"}, {"EXPERIENCE_GATE"}),
             ("опыт 1–3 года", set(), set()), ("Создаём маркетплейс с нуля", {"large_project"}, {"LARGE_PROJECT"}),
             ("Опыт не требуется", set(), set()), ("только Senior", {"experience_gate"}, {"EXPERIENCE_GATE"})]
    watched = {"short_task", "long_task", "large_project", "experience_gate"}
    for row, (_, codes, flags) in zip(run(listings, now, *[{"description": text + t} for t, *_ in cases]), cases):
        assert {r.code for r in row.reasons} & watched == codes
        assert set(row.risk_flags) & {"LARGE_PROJECT", "EXPERIENCE_GATE"} == flags


def test_skip_reasons_are_not_scored(listings, now):
    rows = run(listings, now, {"discovery_skip_reason": "education"}, {"title": "Написать отзывы о Java", "description": None})
    for row in rows:
        assert not row.scored and not row.relevance_gate and row.score == 0 and row.label == "SKIP"
        assert len(row.reasons) == 1 and row.reasons[0].points == 0
    assert rows[0].reasons[0].text == vocab.SKIP_TEXT["education"] and rows[1].complexity == 6


def test_repeated_keywords_add_nothing(listings, now):
    plain, stuffed = run(listings, now, {}, {"title": "Починить вебхуки оплаты в сервисе на FastAPI" + " FastAPI Python n8n" * 20})
    assert points(stuffed, "stack_compatibility") == [2] and len(points(stuffed, "specialization")) == 1


def test_reason_text_uses_exact_age(listings, now):
    row, = run(listings, now, {"published_at": hours_ago(1.25)})
    assert [r.text for r in row.reasons if r.code == "fresh"] == ["Возраст 1.2 ч; бонус свежести +3"]


@pytest.mark.parametrize("values", [{"min_score": 5}, {"max_send": 0}, {"hot_age_hours": 30}, {"max_responses": -1},
                                    {"channels": ()}, {"channels": ("no spaces",)}, {"allow_stack_mismatch": 1}])
def test_profile_rejects_values_out_of_range(values):
    with pytest.raises(ProfileError):
        Profile(**values)


def test_profile_from_settings():
    profile = Profile.from_conf({"gigsift.min_score": "8", "gigsift.allow_stack_mismatch": "true", "gigsift.channels": "Abcde, fghij"})
    assert (profile.min_score, profile.allow_stack_mismatch, profile.channels) == (8, True, ("abcde", "fghij"))
    with pytest.raises(ProfileError):
        Profile.from_conf({"gigsift.min_score": "x"})


def test_default_view_reads_the_candidates_once(spark):
    """Skipped and other rows come from one evaluation of the candidates."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(score):
        made.add(1)
        return score

    rows = spark.range(40).selectExpr("id AS row_id", "cast(id % 7 AS int) AS raw", "1.0D AS age_hours", "1 AS responses_count", "cast(id AS string) AS key")
    graded = rows.withColumn("score", counted("raw")).drop("raw").withColumn("label", F.when(F.col("score") >= 3, "GOOD").otherwise("SKIP"))
    shown = views.default_view(graded).select("row_id", "label", "score").collect()
    assert sum(r.label == "GOOD" for r in shown) == 22 and sorted(r.row_id for r in shown if r.label == "SKIP") == [2, 16, 23, 30, 37]
    assert made.value == 40


def test_identity_that_a_query_does_not_use_is_not_computed(listings, now):
    rows = assess(listings({}), now)
    plan = lambda *names: rows.select(*names)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan("row_id", "score") and "sha2(" in plan("row_id", "score", "fingerprint")


def test_what_no_filter_and_no_result_uses_is_not_computed(listings, now):
    """A query of the complexity alone reads no link and builds no flags; with `fixed` columns it does."""
    plan = lambda rows: rows.select("row_id", "complexity")._jdf.queryExecution().optimizedPlan().toString()
    rows = listings({})
    free, whole = assess(rows, now, fixed=()), assess(rows, now)
    assert "OLDER_THAN_HOT_WINDOW" in plan(whole) and "OLDER_THAN_HOT_WINDOW" not in plan(free) and "direct_url" not in plan(free)
    names = sorted(whole.columns)
    assert sorted(free.columns) == names and whole.select(*names).collect() == free.select(*names).collect()


def test_card_urls(spark):
    rows = [(0, "marketplace", "fl_ru", "7", "https://www.fl.ru/projects/7/x.html?ref=1", None, "https://www.fl.ru/projects/7/x.html"),
            (1, "marketplace", "fl_ru", "8", "https://www.fl.ru/projects/7/x.html", None, None),
            (2, "marketplace", "habr_freelance", "7", "https://www.fl.ru/projects/7/x.html", None, None),
            (3, "repost", "telegram_public", "x", None, "https://www.freelance.ru:443/task/view/5/", "https://www.freelance.ru/task/view/5/"),
            (9, "repost", "telegram_public", "x", None, "https://user@freelance.ru/task/view/5/", None),
            (4, "repost", "telegram_public", "x", None, "http://freelance.ru/task/view/5", None),
            (5, "marketplace", "fl_ru", None, "https://www.fl.ru/projects/7/x.html", None, None),
            (6, None, None, None, None, "https://freelance.habr.com/tasks/9", None), (7, "repost", "a", "b", None, None, None),
            (8, "marketplace", "weblancer", "3", "https://weblancer.net/freelance/a-1/b-3", None, "https://weblancer.net/freelance/a-1/b-3")]
    table = spark.createDataFrame(rows, "n int, origin_kind string, source string, source_id string, url string, external_url string, wanted string")
    assert all(r.direct_url == r.wanted for r in with_direct_card_url(table).collect())
