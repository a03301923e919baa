"""Helpers of the training-data operators: scratch tables, free column names, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gigsift-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a table into the shared folder and read from there: lineage ends, a lost executor costs no rerun."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def kept(df: DataFrame, name: str) -> DataFrame:
    """As `stored`; the shuffle files of the rows go as soon as they are written."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = df.sparkSession.conf.get(setting, None)
    df.sparkSession.conf.set(setting, "true")
    try:
        return stored(df, name)
    finally:
        if before is None:
            df.sparkSession.conf.unset(setting)
        else:
            df.sparkSession.conf.set(setting, before)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that `stored` wrote and nothing reads any more."""
    for table in tables:
        jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
        folder = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        folder.getFileSystem(session.sessionState().newHadoopConf()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it, whatever the case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require(df: DataFrame, *columns: str) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")


def ascii_lower(column):
    """A-Z in lower case; no other letter changes."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def held_out_part(parts: int):
    """Whether a row of `doc_id` belongs to the part held out from learning: crc32(doc_id as text) mod `parts` is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 1, F.lit(False))


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words of the pattern [^\\x20\\x09-\\x0D]+ with A-Z in lower case; bytes.split and bytes.lower know just these characters."""
    return text.lower().split()


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = [value if isinstance(value, pa.Array) else pa.array(value, type=field.type)
              for value, field in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{field.name.replace('`', '``')}` {field.dataType.simpleString()}" for field in df.schema)


def with_computed(df: DataFrame, text: str, added: dict[str, tuple[str, pa.DataType]], compute) -> DataFrame:
    """`df` and the columns `added` (name -> SQL type, Arrow type), of which `compute(texts)` makes a list of values each, for the
    UTF-8 bytes of the column `text` of a batch. Columns of the same names are replaced."""
    base = df.drop(*added)
    at, names = base.columns.index(text), base.columns
    kinds = [kind for _, kind in added.values()]

    def run(batches):
        for batch in batches:
            made = compute(utf8(batch.column(at)))
            arrays = [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*names, *added])

    return base.mapInArrow(run, ", ".join([ddl_of(base), *(f"`{name}` {sql}" for name, (sql, _) in added.items())]))
