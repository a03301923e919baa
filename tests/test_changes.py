"""State as appended changes: versions, folds, lookups by identity, first observation in keyed state."""

from datetime import timedelta

from listing_cases import NOW

from gigsift.operators import changes, history
from gigsift.operators.normalize import with_identity
from gigsift.schema import DELIVERIES, HISTORY
from gigsift.streaming import ingest


def record(i, status="seen"):
    return (f"{i:064x}", "s", str(i), f"https://orders.example.com/{i}", NOW, NOW if status == "sent" else None, status)


def history_of(spark, rows):
    return spark.createDataFrame(rows, HISTORY)


def commit(spark, root, before, after, version, entries=((), ())):
    deliveries = [spark.createDataFrame([(f"s:{i}", "s", str(i), status, NOW, None, None) for i, status in rows], DELIVERIES) for rows in entries]
    changes.Store(spark, root).commit((history_of(spark, before), deliveries[0]), (history_of(spark, after), deliveries[1]), version)


def test_a_run_appends_what_it_changed(spark, tmp_path):
    root, rows = str(tmp_path), [record(i) for i in range(500)]
    table = lambda version=None: {r.source_id: r.status for r in changes.read_table(spark, root, changes.RECORDS, version).collect()}
    appended = lambda version, name="history": spark.read.parquet(changes.snapshot_path(root, name, version)).count()
    commit(spark, root, [], rows, 1, ((), [(0, "pending"), (1, "pending")]))
    commit(spark, root, rows, [*rows, record(1000)], 2, ([(0, "pending"), (1, "pending")], [(0, "pending"), (1, "pending")]))
    assert appended(2) == 1 and appended(2, "identities") == 3 and changes.versions(spark, root, "deliveries") == [1]
    commit(spark, root, [record(0), record(1000)], [record(0, "pending")], 5, ([(0, "pending"), (1, "pending")], [(0, "pending")]))
    assert appended(5) == 2 and table()["0"] == "pending" and "1000" not in table()
    assert len(table(1)) == 500 and len(table(2)) == 501 == len(table(4)) and table(4)["0"] == "seen" and len(table(5)) == 500
    entries = lambda version=None: {r.key: r.since for r in changes.Store(spark, root, version).entries().collect()}
    assert entries() == {"s:0": 1} and entries(4) == {"s:0": 1, "s:1": 1}
    # a replay of version 5 decides otherwise: nothing of its first attempt stays
    commit(spark, root, [record(1)], [record(1, "pending")], 5)
    assert table()["1"] == "pending" and table()["0"] == "seen" and len(table()) == 501


def test_folds_change_nothing_and_expired_changes_go(spark, tmp_path):
    root = str(tmp_path)
    rows = [record(i) for i in range(40)]
    commit(spark, root, [], rows, 1)
    for version in range(2, 7):
        commit(spark, root, [record(version)], [record(version, "pending")], version)
    commit(spark, root, [record(39)], [], 7)
    table = lambda version=None: sorted(map(tuple, changes.read_table(spark, root, changes.RECORDS, version).collect()))
    before = {version: table(version) for version in (4, 5, 6, 7)}
    store = changes.Store(spark, root)
    assert store.upkeep(4)["history"] == [1, 2, 3, 4] and changes.versions(spark, root, "history") == [5, 6, 7]
    assert {version: table(version) for version in before} == before
    probe = spark.createDataFrame([("key", "s:3"), ("url", "https://orders.example.com/39"), ("key", "s:777")], "kind string, value string")
    assert [r.source_id for r in store.matching(probe).collect()] == ["3"] and store.upkeep(4)["history"] == []
    assert store.upkeep(7)["history"] == [5, 6, 7] and changes.versions(spark, root, "history_folded") == [7] and table() == before[7]


def leaves(plan):
    return [plan.collectLeaves().apply(k) for k in range(plan.collectLeaves().size())]


def test_a_small_batch_reads_few_files_and_moves_no_history(spark, tmp_path):
    root = str(tmp_path)
    commit(spark, root, [], [record(i, "sent") for i in range(5000)], 1)
    commit(spark, root, [], [record(i) for i in range(5000, 5010)], 2)
    probes = spark.createDataFrame([("key", f"s:{i}") for i in range(4995, 5005)], "kind string, value string")
    assert {int(r.source_id) for r in changes.Store(spark, root).matching(probes).collect()} == set(range(4995, 5005))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = changes.looked_up(changes.changes(spark, root, changes.IDENTITIES), probes, changes.IDENTITIES.by)
        plan = found._jdf.queryExecution().executedPlan()
        assert len(found.collect()) == 10 and "hashpartitioning" not in plan.toString() and "BroadcastHashJoin" in plan.toString()
        scans = [leaf for leaf in leaves(plan) if "Scan parquet" in leaf.nodeName()]
        assert scans and sum(leaf.metrics().apply("numFiles").value() for leaf in scans) <= 20
        assert "In(value" in plan.toString().replace(" ", "") and changes.SHARDS > 20
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    large = spark.createDataFrame([("key", f"s:{i}") for i in range(3000)], "kind string, value string")
    assert changes.Store(spark, root).matching(large).count() == 3000


def test_a_claimed_record_is_found_by_its_new_key(spark, tmp_path, listings):
    root, none = str(tmp_path), spark.createDataFrame([], DELIVERIES)
    old = with_identity(listings({}))
    seen = history.observe(old, spark.createDataFrame([], HISTORY), NOW)
    store = changes.Store(spark, root)
    store.commit((spark.createDataFrame([], HISTORY), none), (seen, none), 1)
    copy = with_identity(listings({"source": "habr_freelance", "source_id": "77"}))
    slice_ = store.matching(history.listing_identities(copy).select("kind", "value"))
    records, entries, taken = history.reserve(slice_, none, copy, NOW + timedelta(hours=1))
    store.commit((slice_, none), (records, entries), 2)
    again = store.matching(spark.createDataFrame([("key", "habr_freelance:77")], "kind string, value string")).collect()
    assert [(r.source, r.status) for r in again] == [("habr_freelance", "pending")] and taken.count() == 1
    assert [r.since for r in store.entries().collect()] == [2]


def test_keyed_state_gives_each_key_once_over_restarts(spark, tmp_path):
    source, root, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    schema = "key long, ts timestamp"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.stream_first_seen(spark.readStream.schema(schema).parquet(source), "key", "ts", root, log)
        return sorted(map(tuple, spark.read.parquet(root).collect()))

    day = lambda n: (NOW + timedelta(days=n)).replace(tzinfo=None)
    assert run([(1, day(0)), (2, day(2)), (2, day(1)), (None, day(0)), (3, None)]) == [(1, day(0)), (2, day(1))]
    assert run([(1, day(3)), (3, day(3)), (2, day(-5))]) == [(1, day(0)), (2, day(1)), (3, day(3))]
    assert run([(4, day(9)), (3, day(1)), (4, day(8))]) == [(1, day(0)), (2, day(1)), (3, day(3)), (4, day(8))]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ingest.ROCKSDB
