"""Whole runs: streams over page folders, state versions, page limits, one parse for all layouts."""

from datetime import timedelta

import pytest
from listing_cases import NOW

from gigsift.operators import changes, history
from gigsift.plans import run
from gigsift.rules import Profile
from gigsift.schema import DELIVERIES, HISTORY, PAGES
from gigsift.streaming import ingest

LONE = Profile(disabled_sources=("habr_freelance", "fl_ru", "telegram_public", "weblancer"))  # one layout: plans compile faster
ALL = Profile(disabled_sources=(), channels=("freelansim_ru", "orders_feed"))
TASK = """<article class="task-card"><a class="task-card__title-link" href="/task/view/{n}">Починить вебхуки оплаты в сервисе на FastAPI, часть {n}</a>
<div class="task-card__desc">В работающем сервисе теряются уведомления о платежах: исправить обработчик, повторить доставку через API банка, написать проверку. Срок: 2 дня.</div>
<div class="task-card__budget">от 15 000 до 18 000 руб.</div><div class="task-card__foot"><span class="task-card__foot-item" title="21.09.2026 14:30"><i class="fa-clock-o"></i> 1 ч</span>
<span class="task-card__foot-item"><i class="fa-comments"></i> 2</span></div></article>"""


def feed(*numbers):
    return "<html><body><div class='task-feed-list'>" + "".join(TASK.format(n=n) for n in numbers) + "</div></body></html>"


def rows(spark, *pages):
    return spark.createDataFrame([(s, u, 1, i, h, NOW) for i, (s, u, h) in enumerate(pages)], PAGES)


def read(spark, root, name):
    return spark.read.parquet(f"{root}/{name}").drop("version") if changes.versions(spark, str(root), name) else None


def test_a_streamed_run_reserves_and_hands_over(spark, tmp_path):
    root, folder, log, told = tmp_path / "state", tmp_path / "pages", tmp_path / "log", []
    page = rows(spark, ("freelance_ru", "https://freelance.ru/task", feed(501, 502)))
    page.write.parquet(str(folder))
    clock = iter([NOW + timedelta(minutes=m) for m in range(60)])
    attempts = lambda session: session.createDataFrame(told, "key string, attempt int, failure string, http_status int, body string, reply_bytes long, read_seconds double, retry_after string")

    def once(dry_run=False):
        query = ingest.start(ingest.stream_pages(spark, str(folder)), str(root), str(log), LONE, every=None, clock=lambda: next(clock),
                             attempts=attempts, dry_run=dry_run)
        query.awaitTermination()
        return {name: changes.versions(spark, str(root), name) for name in ("history", "identities", "deliveries", "outbox", "metrics")}

    assert once() == {name: [1] for name in ("history", "identities", "deliveries", "outbox", "metrics")}
    assert {r.key for r in read(spark, root, "outbox").collect()} == {"freelance_ru:501", "freelance_ru:502"}
    assert read(spark, root, "events").filter("event = 'source_ok'").count() == 1
    # the sender reports, one new listing comes: only what changed is appended, and the listing sent is not offered again
    told.append(("freelance_ru:501", 0, None, 200, '{"ok": true, "result": {"message_id": 5}}', 60, 0.1, None))
    rows(spark, ("freelance_ru", "https://freelance.ru/task", feed(501, 502, 503))).write.mode("append").parquet(str(folder))
    assert once()["history"] == [1, 2]
    store = changes.Store(spark, root)
    assert {r.key: r.status for r in store.entries().collect()} == {"freelance_ru:501": "sent", "freelance_ru:502": "pending", "freelance_ru:503": "pending"}
    appended = spark.read.parquet(changes.snapshot_path(str(root), "history", 2))
    assert {(r.source_id, r.status) for r in appended.collect()} == {("501", "sent"), ("503", "pending")}
    assert [r.key for r in spark.read.parquet(changes.snapshot_path(str(root), "outbox", 2)).collect()] == ["freelance_ru:503"]
    whole = [changes.read_table(spark, str(root), table) for table in (changes.RECORDS, changes.ENTRIES)]
    assert history.history_problems(*whole).filter("n > 0").collect() == []


def test_a_replayed_batch_gives_the_same_and_a_dry_run_writes_nothing(spark, tmp_path):
    page = rows(spark, ("freelance_ru", "https://freelance.ru/task", feed(501)))
    reports = []
    step = lambda **options: ingest.batch_step(str(tmp_path), LONE, clock=lambda: NOW, report=reports.append, **options)
    step(dry_run=True)(page, 0)
    assert reports[0].candidates.filter("deliverable").count() == 1 and not list(tmp_path.iterdir())
    step()(page, 0)
    state = lambda: [sorted(map(tuple, changes.read_table(spark, str(tmp_path), table).collect())) for table in (changes.RECORDS, changes.ENTRIES)]
    first = state()
    step()(page, 0)
    assert state() == first and [len(rows) for rows in first] == [1, 1] and changes.versions(spark, str(tmp_path), "history") == [1]


def test_damaged_state_stops_a_run(spark):
    record = spark.createDataFrame([("0" * 64, "s", "1", None, NOW, None, "seen")] * 2, HISTORY)
    with pytest.raises(history.StateError, match="duplicate_fingerprint"):
        run.check(rows(spark, ("freelance_ru", "https://freelance.ru/task", feed(1))), NOW, ALL, (record, spark.createDataFrame([], DELIVERIES)))
