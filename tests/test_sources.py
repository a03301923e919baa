"""Extraction per layout, page errors, detail cards, pagination, robots, fetch log, chats."""

import json
import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pages as html
from listing_cases import NOW
from pyspark.sql import functions as F

from gigsift.functions.urls import safe_url
from gigsift.operators import metrics
from gigsift.plans.run import check
from gigsift.rules import Profile
from gigsift.schema import PAGES
from gigsift.sources import detail, frontier, html as flat, scan
from gigsift.sources.layouts import LAYOUTS, extract, page_log

ALL = Profile(disabled_sources=())


def page_table(spark, rows):
    return spark.createDataFrame([(s, u, p, i, h, NOW) for i, (s, u, p, h) in enumerate(rows)], PAGES)


def cards(spark, source, *pages):
    rows = [(source, f"https://x.example/{i}", 1, p) for i, p in enumerate(pages)]
    return extract(page_table(spark, rows), LAYOUTS[source], NOW, ALL)


def test_fl_layout(spark):
    a, b, c, d = sorted(cards(spark, "fl_ru", html.FL).collect(), key=lambda r: r.card_ord)
    assert [x.card_state for x in (a, b, c, d)] == ["ok", "ok", "filtered", "invalid"]
    assert (a.source_id, a.title, a.budget_min, a.budget_max, a.currency) == ("901", "Бот для приёма заявок на Python", 15000, 20000, "RUB")
    assert a.url == "https://www.fl.ru/projects/901/bot-dlya-zayavok.html" and a.responses_count == 3
    assert a.category == "Программирование" and b.category is None
    assert a.published_at == (NOW - timedelta(hours=2, minutes=10)).replace(tzinfo=None) and not a.publication_confirmed
    assert a.publication_evidence == "unconfirmed listing age: 2 часа 10 минут назад" and a.open_status == "unknown"
    assert (b.open_status, b.status_evidence, b.responses_count, b.published_at) == ("awarded", "Исполнитель выбран", 12, None)
    assert d.card_error == "untrusted_url_host"


def test_freelance_layout(spark):
    rows = sorted(cards(spark, "freelance_ru", html.FREELANCE).collect(), key=lambda r: r.card_ord)
    assert [r.card_state for r in rows] == ["ok", "ignored", "ok", "invalid", "invalid"]
    a, _, b, c, d = rows
    assert a.url == "https://freelance.ru/task/view/41?from=feed" and a.source_id == "41"
    assert a.description == "Собрать данные и сохранить в xlsx Срок: 5 дней Опыт: 2 года"
    assert (a.budget_min, a.budget_max, a.responses_count, a.views_count, a.category) == (7000, None, 4, 1204, "Веб / Python")
    assert a.publication_confirmed and a.published_at.hour == 11 and a.published_at.minute == 30
    assert a.publication_evidence == "task-card clock title: 21.09.2026 14:30 (MSK)"
    assert (b.open_status, b.status_evidence, b.publication_confirmed) == ("closed", "Проект закрыт", False)
    assert (c.card_error, d.card_error) == ("untrusted_url_host", "missing_link")


def test_habr_and_weblancer_layouts(spark):
    a, b, c = sorted(cards(spark, "habr_freelance", html.HABR).collect(), key=lambda r: r.card_ord)
    assert (a.source_id, a.category, a.responses_count, a.budget_min) == ("71", "python fastapi", 9, 30000)
    assert a.published_at.hour == 10 and b.published_at is None and c.card_error == "invalid_task_url"
    a, b, c = sorted(cards(spark, "weblancer", html.WEBLANCER).collect(), key=lambda r: r.card_ord)
    assert (a.source_id, a.category, a.budget_max, a.currency) == ("311", "Прикладное ПО, Delphi", Decimal(150), "USD")
    assert (a.responses_count, a.views_count, a.published_at) == (6, 1024, None)
    assert b.card_state == "invalid" and c.category == "novaya-kategoriya" and c.source_id == "312"


def test_channel_posts(spark):
    rows = sorted(cards(spark, "telegram_public", html.POSTS).collect(), key=lambda r: r.card_ord)
    assert [r.card_state for r in rows] == ["ok", "ok", "ok", "filtered", "invalid"]
    a, b, c, _, e = rows
    assert (a.title, a.channel, a.source_id, a.url) == (
        "Доработать telegram-бот на aiogram", "freelansim_ru", "freelansim_ru_11", "https://t.me/freelansim_ru/11")
    assert a.external_url == "https://freelance.ru/task/view/41/?utm_source=tg" and a.origin_kind == "repost"
    assert (a.budget_min, a.currency) == (12000, "RUB") and a.published_at is not None
    assert (b.discovery_skip_reason, b.origin_kind) == ("education", "direct_post")
    assert (c.discovery_skip_reason, c.origin_kind, c.published_at) == ("full_time_vacancy", "repost", None)
    assert e.card_error == "unexpected_post_channel"


def test_page_errors_fail_closed(spark):
    expected = {"fl_ru": "unrecognized_listing_layout", "telegram_public": "public_preview_unavailable_or_empty", "weblancer": "unrecognized_listing_layout"}
    for source, code in expected.items():
        log = {r.url: r for r in page_log(cards(spark, source, html.MALFORMED, html.CHALLENGE)).collect()}
        assert (log["https://x.example/0"].error, log["https://x.example/1"].error) == (code, "challenge_page")
        assert log["https://x.example/0"].parse_errors == 1
    empty = "<div class='task-feed-list'><div class='empty'>нет</div></div>"
    bad = "<article class='task-card'></article>"
    log = {r.url: r for r in page_log(cards(spark, "freelance_ru", empty, bad)).collect()}
    assert log["https://x.example/0"].error is None and log["https://x.example/1"].error == "all_cards_invalid"


def test_check_over_all_layouts(spark):
    table = page_table(spark, [("freelance_ru", "u1", 1, html.FREELANCE), ("habr_freelance", "u2", 1, html.HABR), ("fl_ru", "u3", 1, html.FL),
                               ("fl_ru", "u4", 1, html.FL), ("telegram_public", "u5", 1, html.POSTS), ("telegram_public", "u6", 1, html.CHALLENGE)])
    result = check(table, NOW)
    by_source = {r.source: r for r in result.source_metrics.collect()}
    assert [by_source[s].status for s in ("freelance_ru", "fl_ru", "telegram_public", "weblancer")] == ["ok", "ok", "partial", "disabled"]
    assert by_source["telegram_public"].first_error == "challenge_page"
    assert {s: r.fetched for s, r in by_source.items()} == {"freelance_ru": 2, "habr_freelance": 2, "fl_ru": 2, "telegram_public": 3, "weblancer": 0}
    summary = result.summary.first()
    # the post which links task 41 merges with it
    assert (summary.total_fetched, summary.unique, summary.discovery_duplicates) == (9, 8, 1)
    assert {(r.source, r.error) for r in result.quarantine.collect()} >= {("fl_ru", "untrusted_url_host"), ("telegram_public", "unexpected_post_channel")}
    events = {r.source: r.event for r in metrics.run_events(result.source_metrics, NOW).collect()}
    assert events["telegram_public"] == "source_partial" and events["weblancer"] == "source_disabled"
    errors = {r.source: r.errors for r in metrics.error_counts(result.page_log).collect()}
    assert errors == {"telegram_public": {"challenge_page": 1}}


def test_detail_cards(spark, listings):
    variants = [("", "", ""), (" hidden", "", ""), ("", " disabled", ""), ("", ' class="d-none"', ""), (' style="display: none"', "", ""),
                ("", "", "Исполнитель определён")]
    rows = [("fl_ru", str(i), (html.CARD % v).replace("projectp901", f"projectp{i}")) for i, v in enumerate(variants)]
    rows += [("fl_ru", "90", html.MALFORMED), ("fl_ru", "91", html.CHALLENGE)]
    found = {r.source_id: r for r in detail.read_cards(spark.createDataFrame(rows, "source string, source_id string, html string"), F.lit(NOW)).collect()}
    assert [found[str(i)].reply_open for i in range(6)] == [True, False, False, False, False, True]
    assert found["0"].confirmed_at.hour == 10 and found["0"].date_text == "21.09.2026 13:20" and found["0"].closed is None
    assert (found["5"].closed, found["5"].closed_evidence) == ("awarded", "Исполнитель определён")
    assert (found["90"].card_error, found["91"].card_error) == ("unrecognized_project_card", "challenge_page")
    base = {"source": "fl_ru", "open_status": "unknown", "status_evidence": None, "publication_confirmed": False, "publication_evidence": "listing"}
    given = listings(*[base | {"source_id": str(i), "url": f"https://www.fl.ru/projects/{i}/a.html"} for i in (0, 5, 90)])
    candidates = detail.detail_candidates(given, NOW)
    assert candidates.count() == 3
    updated, log = detail.confirm(given, candidates, spark.createDataFrame(rows, "source string, source_id string, html string"), NOW)
    rows = {r.source_id: r for r in updated.collect()}
    assert rows["0"].open_status == "open" and rows["0"].publication_confirmed and rows["0"].status_evidence == "original card: reply_offer"
    assert rows["5"].open_status == "awarded" and not rows["90"].publication_confirmed
    assert {r.source_id: r.error for r in log.collect()} == {"0": None, "5": None, "90": "unrecognized_project_card"}


def test_next_pages(spark):
    table = page_table(spark, [("fl_ru", "https://www.fl.ru/projects/category/programmirovanie/", 1, html.FL),
                               ("fl_ru", "https://www.fl.ru/projects/category/programmirovanie/page-2/", 2, html.FL),
                               ("fl_ru", "https://www.fl.ru/projects/category/programmirovanie/page-3/", 3, html.FL),
                               ("freelance_ru", "https://freelance.ru/task?c%5B%5D=4", 1, html.FREELANCE),
                               ("freelance_ru", "https://freelance.ru/task?q=api", 1, html.FREELANCE), ("habr_freelance", "https://freelance.habr.com/tasks", 1, html.HABR)])
    found = {(r.source, r.url, r.page_no) for r in frontier.next_pages(table).collect()}
    assert found == {("fl_ru", "https://www.fl.ru/projects/category/programmirovanie/page-2/", 2),
                     ("fl_ru", "https://www.fl.ru/projects/category/programmirovanie/page-3/", 3),
                     ("freelance_ru", "https://freelance.ru/task?c%5B0%5D=4&page=2", 2)}


def test_robots(spark):
    text = """# comment
User-agent: other
Disallow: /

User-agent: *
Disallow: /private
Allow: /private/open
Disallow: /*?sort=
Disallow: /end$
Disallow:
Crawl-delay: 5
Request-rate: 1/12

User-agent: gigsift
User-agent: second
Disallow: /own
Crawl-delay: x
"""
    robots = spark.createDataFrame([("a.example", text), ("b.example", text.replace("gigsift", "third"))], "host string, text string")
    rules = frontier.robots_rules(robots, "GigSift/1.0 (+test)")
    assert {(r.host, r.key, r.value) for r in rules.collect() if r.host == "a.example"} == {
        ("a.example", "disallow", "/own"), ("a.example", "crawl-delay", "x")}
    urls = {"https://a.example/own/1": False, "https://a.example/private": True, "https://b.example/private/x": False,
            "https://b.example/private/open/1": True, "https://b.example/list?sort=1": False, "https://b.example/end": False,
            "https://b.example/ending": True, "https://b.example/own": True, "https://c.example/": True}
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.allowed for r in frontier.robots_allowed(table, rules).collect()} == urls
    delays = {r.host: (r.delay_seconds, r.refused) for r in frontier.crawl_delays(rules).collect()}
    assert delays == {"a.example": (2.0, False), "b.example": (12.0, False)}


def allowed_plainly(path, rules):
    """Longest matching rule by trying them all."""
    best = (-1, True)
    for key, value in rules:
        body = value[:-1] if value.endswith("$") else value
        pattern = ".*".join(re.escape(part) for part in body.split("*")) + (r"\Z" if value.endswith("$") else "")
        if value and re.match(pattern, path):
            best = max(best, (len(value.replace("*", "").rstrip("$")), key == "allow"))
    return best[1]


def test_robots_match_like_trying_every_rule(spark):
    draw = random.Random(8)
    word = lambda: "/" + "".join(draw.choice("ab") for _ in range(draw.randrange(1, 4)))
    rules = {host: [(draw.choice(("allow", "disallow")), "".join(word() for _ in range(draw.randrange(1, 4))) + draw.choice(("", "", "$", "*", "*a$", "*b")))
                    for _ in range(size)] + [("disallow", ""), ("allow", "*aab")] for host, size in (("many.example", 3000), ("few.example", 6))}
    table = spark.createDataFrame([(host, i, *rule) for host, own in rules.items() for i, rule in enumerate(own)], "host string, pos int, key string, value string")
    paths = ["/", *("".join(word() for _ in range(draw.randrange(1, 5))) for _ in range(300))]
    urls = [(i, f"https://{host}{path}") for host in (*rules, "none.example") for i, path in enumerate(paths)] + [(-1, None), (-2, "no url"), (0, f"https://few.example{paths[0]}")]
    got = frontier.robots_allowed(spark.createDataFrame(urls, "i int, url string"), table).collect()
    assert len(got) == len(urls)
    for row in got:
        host = (row.url or "").removeprefix("https://").split("/", 1)[0]
        expected = allowed_plainly(paths[row.i], rules[host]) if row.i >= 0 and host in rules else True
        assert row.allowed == expected, row


def test_robots_cut_a_path_by_its_length_alone(spark):
    """10 000 rules on one host: a path meets the rules of its own cuts, not all of them."""
    numbers = spark.range(10_000)
    rules = numbers.select(F.lit("a.example").alias("host"), F.col("id").cast("int").alias("pos"), F.lit("disallow").alias("key"), F.concat(F.lit("/p"), "id").alias("value"))
    stems = frontier.rules_by_stem(rules)
    assert stems.select(F.max(F.size("wild")), F.count("size"), F.countDistinct(F.length("stem"))).first() == (0, 10_000, 4)
    urls = numbers.select(F.concat(F.lit("https://a.example/"), F.when(F.col("id") % 2 == 0, "p").otherwise("q"), "id").alias("url"))
    assert frontier.robots_allowed(urls, rules).filter("allowed").count() == 5000


def test_fetch_log(spark):
    cases = [((200, "text/html; charset=utf-8", 10, 1.0, False), None), ((404, "text/plain", 1, 1.0, True), None),
             ((404, "text/html", 1, 1.0, False), "unexpected_http_status"), ((503, "text/html", 1, 1.0, False), "temporary_http_error"),
             ((429, "text/html", 1, 1.0, True), "temporary_http_error"), ((403, "text/html", 1, 1.0, False), "access_restricted"),
             ((200, "application/json", 1, 1.0, False), "unexpected_content_type"), ((200, "text/plain", 300000, 1.0, True), "response_too_large"),
             ((200, "text/html", 2 ** 21, 1.0, False), None), ((200, "text/html", 2 ** 21 + 1, 1.0, False), "response_too_large"),
             ((200, "text/html", 1, 46.0, False), "response_deadline_exceeded"), ((None, None, None, None, False), "network_error")]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, s int, t string, n long, r double, robots boolean")
    got = df.select("i", frontier.fetch_error(F.col("s"), F.col("t"), F.col("n"), F.col("r"), F.col("robots")).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [c[1] for c in cases]


def test_stop_after_restriction(spark):
    rows = [("a", 1, 1, None), ("a", 2, 1, "access_restricted"), ("a", 3, 1, None), ("b", 1, 1, None), ("b", 2, 2, "robots_disallowed"),
            ("b", 3, 2, None), ("b", 4, 1, None), ("c", 1, 1, "temporary_http_error"), ("c", 2, 1, None)]
    log = spark.createDataFrame(rows, "source string, seq long, page_no int, error string")
    kept = {(r.source, r.seq) for r in frontier.stop_after_restriction(log).collect()}
    assert kept == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 4), ("c", 1), ("c", 2)}


def test_seeds(spark):
    rows = frontier.seeds(spark, Profile(channels=("abcde", "ABCDE", "fghij"))).collect()
    urls = [r.url for r in rows]
    assert len(urls) == len(set(urls)) == 1 + 10 + 1 + 3 + 2
    assert "https://freelance.ru/task?q=%D0%BF%D0%B0%D1%80%D1%81%D0%B8%D0%BD%D0%B3" in urls
    assert not any(r.source == "weblancer" for r in rows)


def test_latest_chats(spark):
    rows = ['{"update_id": 1, "message": {"date": 10, "chat": {"id": 5, "type": "private", "username": "ivan_1"}}}',
            '{"update_id": 2, "edited_message": {"date": 9, "edit_date": 30, "chat": {"id": 5, "type": "private", "username": "bad name"}}}',
            '{"update_id": 3, "channel_post": {"date": 20, "chat": {"id": -7, "type": "channel"}}, "message": null}',
            '{"update_id": 4, "message": {"date": 1, "chat": {"id": "8", "type": "robot"}}}', '{"update_id": 5, "message": {"chat": 3}}',
            'null', '{}', '{"update_id": 6, "poll": {"id": 1}}', '{"update_id": 7, "message": {"date": 5, "chat": {"id": 0, "type": "group"}}}']
    got = scan.latest_chats(spark.createDataFrame([(r,) for r in rows], "value string")).orderBy(F.desc("date")).collect()
    assert [(r.chat_id, r.type, r.username, r.date) for r in got] == [(5, "private", None, 30), (-7, "channel", None, 20)]


def test_html_files_are_a_page_corpus(spark, tmp_path):
    (tmp_path / "habr_freelance.html").write_text(html.HABR, encoding="utf-8")
    (tmp_path / "note.txt").write_text("x")
    pages = scan.read_pages(spark, str(tmp_path), "html")
    assert [(r.source, r.html) for r in pages.select("source", "html").collect()] == [("habr_freelance", html.HABR)]
    assert extract(pages, LAYOUTS["habr_freelance"], NOW).filter("card_state = 'ok'").count() == 2


def test_a_result_is_written_in_candidate_order(spark, tmp_path):
    summary = spark.createDataFrame([("run-1", 3)], "run_id string, found int")
    schema = "key string, score int, age_hours double, responses_count int, budget_min decimal(12,2), budget_max decimal(12,2), published_at timestamp"
    rows = [(f"k{i:03}", i % 4, None if i % 5 == 0 else float(i % 3), None if i % 7 == 0 else i % 6, Decimal("10.50") if i % 2 else None, None, NOW) for i in range(200)]
    for _ in range(2):  # a second run replaces the first one's documents
        scan.write_result(summary, spark.createDataFrame(rows, schema).repartition(5), str(tmp_path))
    read = lambda name: [json.loads(line) for part in sorted((tmp_path / name).glob("part-*")) for line in part.read_text().splitlines()]
    assert read("summary") == [{"run_id": "run-1", "found": 3}]
    last = float("inf")
    rank = lambda r: (-r[1], last if r[2] is None else r[2], last if r[3] is None else r[3], r[0])
    found = read("projects")
    assert [d["key"] for d in found] == [r[0] for r in sorted(rows, key=rank)]
    by_key = {d["key"]: d for d in found}
    assert by_key["k001"]["budget_min"] == "10.50" and by_key["k002"]["budget_min"] is None and "budget_max" in by_key["k002"]
    assert datetime.fromisoformat(by_key["k001"]["published_at"]).timestamp() == NOW.replace(microsecond=0).timestamp()


def test_plain_markup_is_flattened_as_by_the_parser():
    def parsed(page):
        parser = flat._Flattener()
        parser.feed(page)
        return parser.finish()

    pieces = ['<div class="a b">', "</div>", "<p>", "</p>", "x &amp; y", "&amp;lt;", '<a href="/q?a=1&amp;b=2&copy=3" HREF="z">', "</a>", "<br/>", "<br>", "<!-- c -->",
              "<title>a &amp; b</title>", " \r\n ", "Ａ", "\x1f", "<i disabled>", "<b/>", "</span>", "&am", '<LI Class="">', '<script>a="</p>";</script>', "<style>q</style>",
              '<div\n id="1"\tid="2">', "<!DOCTYPE html>", "</br>"]
    odd = ["<title>", "<script>", "</script>", "<", "<a href=x>", "<u class='q'>", "<!-->", "<textarea>", "<noscript>", '<p class="a"b="c">', "</li >", "<?php x>"]
    draw, plain = random.Random(5), 0
    cases = [value for name, value in vars(html).items() if name.isupper() and isinstance(value, str)]
    cases += ["".join(draw.choice(pieces) for _ in range(draw.randrange(14))) for _ in range(1500)]
    cases += ["".join(draw.choice(pieces + odd) for _ in range(draw.randrange(14))) for _ in range(1500)]
    for page in cases:
        found = flat._plain_nodes(page)
        plain += found is not None
        expected = parsed(page)
        nodes = [(n["stop"], n["up"], n["tag"], n["attrs"], n["start"], n["size"]) for n in expected["nodes"]]
        for text, rows in filter(None, (found, flat._any_nodes(page))):
            assert text == expected["text"] and [(*n[:3], list(n[3].items()), *n[4:]) for n in rows] == nodes
    assert 1500 < plain < len(cases)
    built = flat._flatten([*cases, None, ""])
    assert built.to_pylist()[:-2] == [flat.pa.scalar(parsed(page), flat._ARROW).as_py() for page in cases]
    assert built.to_pylist()[-2:] == [None, {"text": "", "nodes": []}]


def test_pages_share_columns_and_a_refused_one_leaves_nothing_in_them():
    out = flat._Nodes()
    assert flat._plain_page('<p class="a  b" id="1">x<br></p>', out) == "x"
    rows, ends = out.rows(), (list(out.class_ends), list(out.attr_ends))
    assert [(row[2], row[3]) for row in rows] == [("p", {"id": "1", "class": "a  b"}), ("#text", {}), ("br", {})]
    assert flat._plain_page('<i class="c">y</i><a href=x>', out) is None
    assert out.rows() == rows and (out.class_ends, out.attr_ends) == ends and out.classes == ["a", "b"]
    assert flat._plain_page("<b>z</b>", out) == "z" and out.rows()[3:] == [[1, -1, "b", {}, 0, 1], [1, 0, "#text", {}, 0, 1]]


def test_a_card_link_is_resolved_once(spark):
    pages = spark.createDataFrame([("freelance_ru", "u", 1, 0, html.FREELANCE, None)], PAGES)
    plan = extract(pages, LAYOUTS["freelance_ru"], NOW, ALL).select("source_id", "url", "card_error")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count(r"\A[^?#]*(.*)\z") <= 2
