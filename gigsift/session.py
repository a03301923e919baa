"""Session settings and small helpers shared by the jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows of page tables are wide: Arrow batches are bounded by bytes
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def build_session(app: str = "gigsift", master: str | None = None, **conf: str) -> SparkSession:
    # Classification compiles to large methods; without this flag the JVM would interpret them.
    flags = "-XX:-DontCompileHugeMethods"
    conf = {"spark.driver.extraJavaOptions": flags, "spark.executor.extraJavaOptions": flags, **conf}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs rely on to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gigsift-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, source: DataFrame | None = None) -> DataFrame:
    """Use all cores for row-wise heavy work where `source`, the table the rows come from, is read by fewer tasks than there are cores;
    a table of more files or row groups keeps the partitioning of its scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if (df if source is None else source).rdd.getNumPartitions() < cores else df


def settled(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns passed through a one-row generator.

    Filters on a column deep in a chain of projections are otherwise copied into every expression it is made of, and plans
    grow exponentially. A generator is the one narrow operator they are not moved through; no shuffle, no extra rows.
    """
    rest = [name for name in df.columns if name not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names)))) if names else df
