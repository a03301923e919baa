"""The batch jobs over streams of pages, listings and events."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes, history, metrics
from ..plans.run import Result, check, plan_delivery, reconcile
from ..rules import Profile
from ..schema import PAGES
from ..session import checkpoint


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages as they arrive in a folder of parquet files."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


Reader = Callable[[SparkSession], DataFrame]
FOLD_EVERY = 144  # a day of runs every ten minutes


def batch_step(root: str, profile: Profile = Profile(), clock: Callable[[], datetime] | None = None, dry_run: bool = False,
               attempts: Reader | None = None, details: Reader | None = None, report: Callable[[Result], None] | None = None,
               fold_every: int = FOLD_EVERY):
    """Function for `foreachBatch`: one run over the batch against the newest state under `root`.

    First the sender's `attempts` on deliveries that are pending are settled, then the batch is checked, with the original cards of
    `details`, and what may be sent is reserved and handed to the outbox. Only records that share an identity with the batch or with a
    pending delivery are read, and only rows that changed are appended. A batch reads what versions below its own number hold and writes
    its own, so a replay after a lost driver gives the same tables. Nothing is appended if nothing changed, and nothing at all is written in
    a dry run. Every `fold_every` batches, older changes are folded together and removed. `report` gets the result of each check.
    """
    tell = clock or (lambda: datetime.now(timezone.utc))

    def step(pages: DataFrame, batch: int) -> None:
        spark, now = pages.sparkSession, tell()
        store = changes.Store(spark, root, batch)
        if fold_every and batch and batch % fold_every == 0 and not dry_run:
            store.upkeep(batch)
        dated = checkpoint(store.entries())
        read, entries, settled = [], dated.drop("since"), None
        before = entries
        pending = dated.filter("status = 'pending'").select("key", "since")
        if attempts is not None and not pending.isEmpty():
            told = checkpoint(attempts(spark).join(pending.select("key"), "key", "left_semi"))
            sent = store.sent_rows(pending)
            probes = pending.select(F.lit("key").alias("kind"), F.col("key").alias("value"))
            if sent is not None:
                probes = probes.union(history.listing_identities(sent, "key").select("kind", "value"))
            read.append(checkpoint(store.matching(probes)))
            settled, entries = reconcile((read[0], entries), sent, told, now)

        def known(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
            found = checkpoint(store.matching(history.listing_identities(listings).select("kind", "value")))
            read.append(found)
            if settled is not None:
                found = checkpoint(found.join(settled.select("fingerprint"), "fingerprint", "left_anti").unionByName(settled))
            return found, entries

        result = check(pages, now, profile, known, details(spark) if details else None)
        if report:
            report(result)
        if dry_run:
            return
        box, *after = plan_delivery(result, result.known, now, tell(), profile)
        records = read[0] if len(read) == 1 else read[0].unionByName(read[1]).dropDuplicates(["fingerprint"])
        store.commit((records, before), tuple(after), batch + 1)
        if not box.isEmpty():
            changes.write_snapshot(box, root, "outbox", batch + 1)
        changes.write_snapshot(result.source_metrics, root, "metrics", batch + 1)
        changes.write_snapshot(metrics.run_events(result.source_metrics, now), root, "events", batch + 1)

    return step


def start(pages: DataFrame, root: str, checkpoint_dir: str, profile: Profile = Profile(), every: str | None = "10 minutes",
          **options) -> StreamingQuery:
    """Run every interval, or once over all that is there (`every=None`). Further options are those of `batch_step`."""
    writer = pages.writeStream.foreachBatch(batch_step(root, profile, **options)).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# --- first observation per key ----------------------------------------------------------------------------------------


def first_seen(events: DataFrame, key: str, at: str) -> DataFrame:
    """First observation per key: built-in aggregation, also over a stream in update mode."""
    return events.groupBy(key).agg(F.min(at).alias("first_seen_at"))


def fold_first_seen(events: DataFrame, key: str, at: str, root: str, checkpoint_dir: str) -> None:
    """Append the first observation per key and batch of everything a stream holds, as versions; a replayed batch replaces its own."""
    def step(batch: DataFrame, number: int) -> None:
        changes.write_snapshot(first_seen(batch, key, at), root, "first_seen", number + 1)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir)
    writer.trigger(availableNow=True).start().awaitTermination()


def read_first_seen(spark: SparkSession, root: str, key: str) -> DataFrame:
    """First observation per key over all versions."""
    paths = [changes.snapshot_path(root, "first_seen", version) for version in changes.versions(spark, root, "first_seen")]
    return first_seen(spark.read.parquet(*paths), key, "first_seen_at")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_seen_changes(events: DataFrame, key: str, at: str) -> DataFrame:
    """Emits a key once, when a batch first holds it, with its earliest time in that batch; its state never expires. Rows without a key or a
    time are left out. Needs the RocksDB state store, which `stream_first_seen` sets."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class FirstSeen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("first_seen", "at timestamp")

        def handleInputRows(self, key_values, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            earliest = min(frame[at].min() for frame in rows)
            if not self.seen.exists():
                self.seen.update((earliest.to_pydatetime(),))
                yield pd.DataFrame({key: [key_values[0]], "first_seen_at": [earliest]})

        def close(self) -> None:
            pass

    kind = events.schema[key].dataType.simpleString()
    known = events.select(key, F.col(at).cast("timestamp").alias(at)).dropna()
    return known.groupBy(key).transformWithStateInPandas(FirstSeen(), f"{key} {kind}, first_seen_at timestamp", "append", "none")


def stream_first_seen(events: DataFrame, key: str, at: str, root: str, checkpoint_dir: str) -> None:
    """Run `first_seen_changes` over all there is, on from where the last run ended, and append new keys to `root`. State is kept per key in
    RocksDB under `checkpoint_dir`; the file sink takes a replayed batch once."""
    conf, setting = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(setting, None)
    conf.set(setting, ROCKSDB)
    try:
        writer = first_seen_changes(events, key, at).writeStream.outputMode("append").option("checkpointLocation", checkpoint_dir)
        query = writer.format("parquet").option("path", root).trigger(availableNow=True).start()
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)
    query.awaitTermination()
