"""Components, survivors, history and delivery state on small fixtures."""

from datetime import timedelta
from random import Random

from listing_cases import NOW

from gigsift.operators import dedup, history
from gigsift.operators.normalize import with_identity
from gigsift.operators.precedence import first_come
from gigsift.rules import Profile
from gigsift.schema import DELIVERIES, HISTORY


def brute_components(edges):
    label = {n: n for n, _ in edges}
    changed = True
    while changed:
        changed = False
        for a, x in edges:
            for b, y in edges:
                if x == y and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_components_follow_chains_and_hubs(spark):
    chain = [(i, f"c{i // 2}") for i in range(1, 12)] + [(i, f"d{(i + 1) // 2}") for i in range(1, 12)]
    hub = [(100 + i, "hub") for i in range(20)] + [(119, "c0"), (300, "alone")]
    edges = chain + hub
    table = spark.createDataFrame([(n, "k", v) for n, v in edges], "row_id long, kind string, value string")
    found = {r.row_id: r.component for r in dedup.components(table).collect()}
    expected = brute_components(edges)
    assert {n: found.get(n, n) for n in expected} == expected and 300 not in found


def test_survivor_and_safety(listings):
    url = "https://freelance.ru/task/view/5150"
    post = {"source": "telegram_public", "source_id": "feed_1", "url": "https://t.me/feed_name/1", "external_url": url, "origin_kind": "repost",
            "publication_confirmed": False}
    closed = {"open_status": "closed", "status_evidence": "closed label", "published_at": NOW - timedelta(hours=1)}
    rows = dedup.deduplicate(listings(post, {}, closed, {"source_id": "5151", "url": "https://freelance.ru/task/view/5151", "title": "Другая задача"})).collect()
    merged = {r.source_id: r for r in rows}
    assert set(merged) == {"5150", "5151"} and merged["5150"].origin_kind == "marketplace"
    assert merged["5150"].open_status == "closed" and not merged["5150"].publication_confirmed
    assert merged["5150"].publication_evidence == "conflicting original publication fields"


def test_history_cycle(spark, listings):
    empty = spark.createDataFrame([], HISTORY), spark.createDataFrame([], DELIVERIES)
    rows = with_identity(listings({}, {}, {"source_id": "5151", "url": "https://freelance.ru/task/view/5151", "title": "Другая задача"}))
    seen = history.observe(rows, empty[0], NOW)
    assert {r.source_id: r.status for r in seen.collect()} == {"5150": "seen", "5151": "seen"}
    picked = rows.filter("row_id = 0")
    records, entries, taken = history.reserve(seen, empty[1], picked, NOW)
    assert [r.key for r in taken.collect()] == ["freelance_ru:5150"]
    assert {r.source_id: r.status for r in records.collect()} == {"5150": "pending", "5151": "seen"}
    assert {r.row_id: r.already_seen for r in history.mark_seen(rows, records, entries).collect()} == {0: True, 1: True, 2: False}
    outcome = spark.createDataFrame([("freelance_ru:5150", "definite")], "key string, outcome string")
    released, left = history.settle(records, entries, picked, outcome, NOW)
    assert {r.status for r in released.collect()} == {"seen"} and left.count() == 0
    sent, kept = history.settle(records, entries, picked, outcome.selectExpr("key", "'sent' AS outcome"), NOW)
    assert {r.source_id: r.status for r in sent.collect()} == {"5150": "sent", "5151": "seen"}
    assert [r.status for r in kept.collect()] == ["sent"]


def batch_of(listings, n, **same):
    """Listings that share nothing."""
    return with_identity(listings(*[{"source_id": str(9000 + i), "url": f"https://freelance.ru/task/view/{9000 + i}",
                                     "title": f"Исправить расчёт остатков на складе, участок {i}"} | same for i in range(n)]))


def no_problems(records, entries):
    return history.history_problems(records, entries).filter("n > 0").collect() == []


def test_all_outcomes_are_applied(spark, listings):
    rows = batch_of(listings, 25)
    empty = spark.createDataFrame([], HISTORY), spark.createDataFrame([], DELIVERIES)
    records, entries, taken = history.reserve(empty[0], empty[1], rows, NOW, Profile(max_send=10))
    assert taken.count() == 25 and no_problems(records, entries)
    outcome = entries.selectExpr("key", "'sent' AS outcome")
    records, entries = history.settle(records, entries, rows, outcome, NOW)
    assert {r.status for r in records.collect()} == {"sent"} == {r.status for r in entries.collect()}
    assert records.count() == entries.count() == 25 and no_problems(records, entries)
    again = history.settle(records, entries, rows, entries.selectExpr("key", "'definite' AS outcome"), NOW + timedelta(hours=1))
    assert history.same_rows(again[0], records) and history.same_rows(again[1], entries)


def test_one_claim_per_record(spark, listings):
    first = batch_of(listings, 1)
    seen = history.observe(first, spark.createDataFrame([], HISTORY), NOW)
    # one finds the record by its key, the other by its address; the better rank wins
    other = {"source": "habr_freelance", "url": "https://freelance.ru/task/view/9000", "source_id": "1", "title": "Другое название той же задачи целиком"}
    picked = with_identity(listings(other, {"source_id": "9000", "url": "https://freelance.ru/task/view/9000", "title": "Ещё одно название задачи"}))
    for order, winner in (("row_id", "habr_freelance:1"), ("1 - row_id", "freelance_ru:9000")):
        ranked = picked.selectExpr("*", f"{order} AS rank")
        records, entries, taken = history.reserve(seen, spark.createDataFrame([], DELIVERIES), ranked, NOW)
        assert [r.key for r in entries.collect()] == [winner] == [r.key for r in taken.collect()]
        assert [r.status for r in records.collect()] == ["pending"] and no_problems(records, entries)
        assert history.reserve(records, entries, ranked, NOW)[2].isEmpty()


def test_a_shared_url_makes_no_pairs_of_listings_and_records(spark, listings, monkeypatch):
    """300 listings and 300 records share one URL: no step holds a row per pair, the first listing claims the earliest record."""
    n, url = 300, "https://orders.example.com/u/1"
    past = spark.range(n).selectExpr("sha2(concat('r', id), 256) AS fingerprint", "'users' AS source", "cast(id AS string) AS source_id", f"'{url}' AS normalized_url",
                                     "timestamp_seconds(1000 + (id + 7) % 300) AS first_seen_at", "cast(NULL AS timestamp) AS sent_at", "'seen' AS status")
    rows = spark.range(n).selectExpr("id AS row_id", "concat('clicks:', id) AS key", "'clicks' AS source", "cast(id AS string) AS source_id",
                                     "sha2(concat('c', id), 256) AS fingerprint", f"'{url}' AS url", f"'{url}' AS canonical", "cast(NULL AS string) AS direct_url")
    sizes, keep = [], history.checkpoint

    def counted(df):
        df = keep(df)
        sizes.append(df.count())
        return df

    monkeypatch.setattr(history, "checkpoint", counted)
    records, entries, taken = history.reserve(past, spark.createDataFrame([], DELIVERIES), rows, NOW)
    assert max(sizes) <= 4 * n
    assert [(r.source, r.source_id) for r in records.filter("status = 'pending'").collect()] == [("clicks", "0")]
    assert [r.key for r in taken.collect()] == ["clicks:0"] and records.count() == n
    outcomes = spark.createDataFrame([("clicks:0", "sent"), ("clicks:0", "definite")], "key string, outcome string")
    records, entries = history.settle(records, entries, taken, outcomes, NOW)
    assert records.filter("status = 'sent' AND sent_at IS NOT NULL").count() == n and [r.status for r in entries.collect()] == ["sent"]


def test_conflicting_outcomes_and_release(spark, listings):
    rows = batch_of(listings, 4)
    records, entries, _ = history.reserve(spark.createDataFrame([], HISTORY), spark.createDataFrame([], DELIVERIES), rows, NOW)
    told = [(9000, "definite"), (9000, "sent"), (9000, "uncertain"), (9001, "definite"), (9001, "uncertain"), (9002, "definite"), (7, "sent")]
    outcome = spark.createDataFrame([(f"freelance_ru:{n}", o) for n, o in told], "key string, outcome string")
    records, entries = history.settle(records, entries, rows.limit(0), outcome, NOW)
    assert {r.source_id: r.status for r in records.collect()} == {"9000": "sent", "9001": "pending", "9002": "seen", "9003": "pending"}
    assert {r.source_id: r.status for r in entries.collect()} == {"9000": "sent", "9001": "pending", "9003": "pending"}
    assert no_problems(records, entries)


def test_retention_drops_the_oldest_sent(spark):
    rows = [(f"s:{i}", "s", str(i), "sent" if i % 2 else "pending", NOW, NOW - timedelta(minutes=i) if i % 2 else None, None) for i in range(120)]
    deliveries = spark.createDataFrame(rows, DELIVERIES)
    kept = {r.source_id for r in history.retain(deliveries, 100, 5).collect()}
    gone = sorted((str(i) for i in range(1, 120, 2)), key=int, reverse=True)[:25]
    assert kept == {str(i) for i in range(120)} - set(gone)


def test_retention_is_exact_among_equal_times_without_a_sort(spark):
    random = Random(3)
    keys = [f"s:{'x' * random.randrange(3)}{i}" for i in range(200)] + ["s:é1", "s:😀", "s:"]
    rows = [(key, "s", key[2:], "sent", NOW, NOW - timedelta(days=random.choice((0, 0, 1, 400))), None) for key in keys]
    deliveries = spark.createDataFrame(rows, DELIVERIES)
    order = sorted(rows, key=lambda row: (row[5], row[0].encode()))
    for excess in (1, 40, 97, 150, 202):
        kept = history.retain(deliveries, len(rows) + 1 - excess)
        assert {r.key for r in kept.collect()} == {row[0] for row in order[excess:]}
    plan = history.retain(deliveries, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def sequential(asked, offered):
    taken, given = set(), set()
    for row in sorted(asked):
        if not asked[row] & given:
            taken.add(row)
            given |= offered.get(row, set())
    return taken


def test_first_come_matches_the_sequential_rule_in_few_rounds(spark):
    random, asked, offered = Random(5), {}, {}
    for row in range(300):
        asked[row] = {f"t{random.randrange(90)}" for _ in range(random.randrange(1, 4))}
        offered[row] = set(random.sample(sorted(asked[row]), 1)) | ({f"t{random.randrange(90)}"} if row % 3 == 0 else set())
    asked |= {1000 + i: {f"c{i}", f"c{i - 1}"} for i in range(10_000)}
    offered |= {1000 + i: {f"c{i}"} for i in range(10_000)}
    table = lambda pairs: spark.createDataFrame([(r, "k", v) for r, values in pairs.items() for v in values], "row_id long, kind string, value string")
    rounds = []
    found = {r.row_id for r in first_come(table(asked), table(offered), rounds.append).collect()}
    assert found == sequential(asked, offered) and len(rounds) <= 14


def test_a_busy_key_is_folded_in_even_stretches(spark):
    random, rows = Random(8), []
    for seq in range(3000):  # a third of all events is one key's, within one day
        key = 7 if seq % 3 == 0 else 100 + random.randrange(400)
        rows.append((key, (NOW + timedelta(seconds=random.randrange(80_000))).replace(tzinfo=None), seq, random.choice(("observe", "reserve", "release", "sent"))))
    log = spark.createDataFrame(rows, "key long, ts timestamp, seq long, action string").repartition(8)
    expected = {}
    for key, at, seq, action in sorted(rows):
        seen, sent, is_open = expected.get(key, (None, None, False))
        if action in ("observe", "reserve"):
            seen = seen or at
        if action == "sent" and is_open:
            sent = sent or at
        expected[key] = seen, sent, action == "reserve" or (is_open and action != "release")
    found = {r.key: (r.first_seen_at, r.sent_at, r.status) for r in history.fold_state(log).collect()}
    assert found == {key: (seen, sent, "sent" if sent else "pending" if is_open else "seen") for key, (seen, sent, is_open) in expected.items() if seen}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in history.log_stretches(log).filter("key = 7").groupBy("_stretch").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1000 and max(sizes) <= 600


def test_within_source_duplicates_follow_the_sequential_rule(listings):
    url = "https://freelance.ru/task/view/%d"
    a, b, c = {"source_id": "1", "url": url % 1}, {"source_id": "2", "url": url % 2}, {"source_id": "1", "url": url % 2}
    d = {"source_id": "3", "url": url % 2, "open_status": "closed", "status_evidence": "label"}  # follows c, which has become a copy of a
    rows = {r.row_id: r for r in dedup.exact_dedup(with_identity(listings(a, b, c, d))).collect()}
    assert set(rows) == {0, 1} and (rows[0].open_status, rows[1].open_status) == ("closed", "open")
