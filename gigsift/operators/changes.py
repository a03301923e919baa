"""State as rows of changes: a run appends what it changed, readers take the newest row per key, and a job folds old changes together.

A table is a folder of versions, written by Spark as `version=N/shard=S`; the shard is a hash of the columns the table is looked up by, so a
batch opens only the shards it may match, and Parquet's bloom filters pass over row groups without its values. A version is written whole
or not at all, and again by a replay of the same batch. `<table>_folded` holds the newest rows as of a version; changes up to the newest
fold that no reader before it needs may go.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import DELIVERIES, HISTORY
from ..session import checkpoint
from .precedence import KEYS

SHARDS = 64
FEW, LIGHT = 1000, 100_000  # lookups up to FEW rows are pushed into the scan as values, those up to LIGHT are broadcast


@dataclass(frozen=True)
class Table:
    """Its name, the columns of a row, the key of which the newest row counts, and what rows are looked up by."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    by: tuple[str, ...]

    @property
    def columns(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("since", T.LongType())])


IDENTITY = T.StructType([T.StructField(name, T.StringType()) for name in (*KEYS, "fingerprint")])
RECORDS = Table("history", HISTORY, ("fingerprint",), ("fingerprint",))
ENTRIES = Table("deliveries", DELIVERIES, ("key",), ("key",))
IDENTITIES = Table("identities", IDENTITY, (*KEYS, "fingerprint"), tuple(KEYS))


def snapshot_path(root: str, table: str, version: int) -> str:
    return f"{root.rstrip('/')}/{table}/version={version:012d}"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def versions(spark: SparkSession, root: str, table: str, at_most: int | None = None) -> list[int]:
    """Completely written versions of a table, in order."""
    fs, folder = _folder(spark, f"{root.rstrip('/')}/{table}")
    if not fs.exists(folder):
        return []
    done = [status.getPath() for status in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))]
    found = sorted(int(path.getName().split("=")[1]) for path in done)
    return [version for version in found if at_most is None or version <= at_most]


def write_snapshot(df: DataFrame, root: str, table: str, version: int) -> None:
    """Write a version; writing it again replaces it, so a replayed batch is harmless."""
    df.write.mode("overwrite").parquet(snapshot_path(root, table, version))


def shard(columns: Sequence[str]):
    return F.pmod(F.xxhash64(*columns), F.lit(SHARDS)).cast("int")


def _write(rows: DataFrame, root: str, name: str, table: Table, version: int) -> None:
    dealt = rows.withColumn("shard", shard(table.by)).repartition("shard").sortWithinPartitions("shard", *table.by)
    writer = dealt.write.mode("overwrite").partitionBy("shard").option(f"parquet.bloom.filter.enabled#{table.by[-1]}", "true")
    writer.parquet(snapshot_path(root, name, version))


def append(rows: DataFrame, root: str, table: Table, version: int) -> None:
    """Write changed `rows` (with the column gone) as a version."""
    _write(rows.withColumn("since", F.lit(version).cast("long")), root, table.name, table, version)


def difference(before: DataFrame, after: DataFrame, table: Table) -> DataFrame:
    """The rows to append so that `after` is read where `before` was: new and changed ones, and those that are gone."""
    names, key = table.schema.fieldNames(), list(table.key)
    packed = lambda df, name: df.select(*key, F.struct(*names).alias(name))
    both = packed(before, "_old").join(packed(after, "_new"), key, "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(F.coalesce("_new", "_old").alias("_row"), F.col("_new").isNull().alias("gone")).select("_row.*", "gone")


def changes(spark: SparkSession, root: str, table: Table, at_most: int | None = None) -> DataFrame:
    """All rows from the newest fold on, up to a version, with the columns gone, since and shard."""
    folds = versions(spark, root, f"{table.name}_folded", at_most)
    newer = [version for version in versions(spark, root, table.name, at_most) if not folds or version > folds[-1]]
    schema = T.StructType([*table.columns.fields, T.StructField("shard", T.IntegerType())])
    read = lambda name, chosen: spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/{name}").parquet(
        *[snapshot_path(root, name, version) for version in chosen]).select(*schema.fieldNames())
    parts = [read(name, chosen) for name, chosen in ((f"{table.name}_folded", folds[-1:]), (table.name, newer)) if chosen]
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def newest(rows: DataFrame, table: Table) -> DataFrame:
    """The newest row of each key, with the version it is from, without those that are gone."""
    last = rows.groupBy(*table.key).agg(F.max_by(F.struct(*table.columns.fieldNames()), "since").alias("_row"))
    return last.select("_row.*").filter("NOT gone").select(*table.schema.fieldNames(), "since")


def looked_up(rows: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Those of `rows` (from `changes`) which `wanted` asks for. Only its shards are listed, and up to LIGHT lookups move to the rows instead
    of the rows to them."""
    asked = checkpoint(wanted.select(*by).distinct().withColumn("shard", shard(by)))
    count = asked.count()
    shards = [row["shard"] for row in asked.select("shard").distinct().collect()]
    rows = rows.filter(F.col("shard").isin(shards))
    if count <= FEW:
        rows = rows.filter(F.col(by[-1]).isin([row[0] for row in asked.select(by[-1]).distinct().collect()]))
    return rows.join(F.broadcast(asked) if count <= LIGHT else asked, ["shard", *by], "left_semi")


def read_table(spark: SparkSession, root: str, table: Table, at_most: int | None = None) -> DataFrame:
    """A whole table as of a version."""
    return newest(changes(spark, root, table, at_most), table).select(*table.schema.fieldNames())


def fold(spark: SparkSession, root: str, table: Table, at: int) -> None:
    """Write the newest rows as of a version, unless that is done."""
    if versions(spark, root, f"{table.name}_folded", at)[-1:] != [at]:
        _write(newest(changes(spark, root, table, at), table).withColumn("gone", F.lit(False)), root, f"{table.name}_folded", table, at)


def expire(spark: SparkSession, root: str, table: Table, keep: int) -> list[int]:
    """Remove the changes and folds which no reader as of `keep` or later needs; returns the versions of the changes removed."""
    folds = versions(spark, root, f"{table.name}_folded", keep)
    if not folds:
        return []
    gone = versions(spark, root, table.name, folds[-1])
    for name, old in ((table.name, gone), (f"{table.name}_folded", folds[:-1])):
        for version in old:
            fs, folder = _folder(spark, snapshot_path(root, name, version))
            fs.delete(folder, True)
    return gone


# --- history and deliveries ------------------------------------------------------------------------------------------


class Store:
    """History, its identities and deliveries under a root, as of a version."""

    def __init__(self, spark: SparkSession, root: str, at_most: int | None = None):
        self.spark, self.root, self.at_most = spark, str(root).rstrip("/"), at_most

    def _rows(self, table: Table) -> DataFrame:
        return changes(self.spark, self.root, table, self.at_most)

    def entries(self) -> DataFrame:
        """All deliveries, with the version of their last change. There are as many as the retention limit allows."""
        return newest(self._rows(ENTRIES), ENTRIES)

    def matching(self, probes: DataFrame) -> DataFrame:
        """History records that have, or once had, one of the identities `probes` (kind, value)."""
        hits = looked_up(self._rows(IDENTITIES), probes, IDENTITIES.by).select("fingerprint")
        return newest(looked_up(self._rows(RECORDS), hits, RECORDS.by), RECORDS).select(*HISTORY.fieldNames())

    def sent_rows(self, pending: DataFrame) -> DataFrame | None:
        """The outbox rows behind `pending` (key, since): each from the version in which it was reserved."""
        wanted = {row["since"] for row in pending.select("since").distinct().collect()}
        chosen = [version for version in versions(self.spark, self.root, "outbox", self.at_most) if version in wanted]
        if not chosen:
            return None
        boxes = self.spark.read.option("basePath", f"{self.root}/outbox").parquet(*[snapshot_path(self.root, "outbox", version) for version in chosen])
        return boxes.join(pending.select("key", F.col("since").alias("version")), ["key", "version"], "left_semi")

    def commit(self, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], version: int) -> None:
        """Append what differs between two states (history, deliveries), each of the records and deliveries a run has read."""
        from .history import history_identities
        records = checkpoint(difference(before[0], after[0], RECORDS))
        entries = checkpoint(difference(before[1], after[1], ENTRIES))
        if not records.isEmpty():
            # looked up by identity first: a record nothing points to would be lost, a pointer without its record finds nothing
            named = history_identities(records.filter("NOT gone"), "fingerprint").withColumn("gone", F.lit(False))
            append(named, self.root, IDENTITIES, version)
            append(records, self.root, RECORDS, version)
        if not entries.isEmpty():
            append(entries, self.root, ENTRIES, version)

    def upkeep(self, at: int) -> dict[str, list[int]]:
        """Check the whole state as of a version, fold it, and remove the changes before it."""
        from .history import require_valid
        require_valid(*(read_table(self.spark, self.root, table, at) for table in (RECORDS, ENTRIES)))
        gone = {}
        for table in (RECORDS, IDENTITIES, ENTRIES):
            fold(self.spark, self.root, table, at)
            gone[table.name] = expire(self.spark, self.root, table, at)
        return gone
