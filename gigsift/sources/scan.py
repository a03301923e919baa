"""Reading page corpora, chat updates and listings; writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..operators.views import candidate_order, latest_per_key
from ..schema import PAGES


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page table from parquet/orc/json files, or from one HTML file per source (`<source>.html`).

    HTML files are read as bytes: one row per file, named after its source, decoded as UTF-8.
    """
    if fmt != "html":
        return spark.read.schema(PAGES).format(fmt).load(path)
    name = F.regexp_extract("path", r"([^/]+)\.html\z", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.select(name.alias("source"), F.col("path").alias("url"), F.lit(1).alias("page_no"), F.lit(0).cast("bigint").alias("seq"),
                        F.decode("content", "UTF-8").alias("html"), F.col("modificationTime").alias("fetched_at"))


CHAT = "struct<id:string,type:string,username:string>"
MESSAGE = f"struct<date:string,edit_date:string,chat:{CHAT}>"


def latest_chats(updates: DataFrame) -> DataFrame:
    """(chat_id, type, username, date, update_id) of every chat, from JSON texts in column `value`.

    Each update may hold six kinds of message; wrong ids and types are dropped, odd usernames hidden, and the newest
    message of a chat wins.
    """
    c = F.col
    fields = ", ".join(f"{kind} string" for kind in vocab.UPDATE_KINDS)
    parsed = updates.filter(c("value").rlike(r"\A\s*\{")).select(F.from_json("value", f"update_id string, {fields}").alias("u"))
    messages = parsed.select(_integer(c("u.update_id")).alias("update_id"), F.explode(F.array(*[c(f"u.{k}") for k in vocab.UPDATE_KINDS])).alias("m"))
    rows = messages.filter(c("m").rlike(r"\A\s*\{")).select("update_id", F.from_json("m", MESSAGE).alias("m")).select(
        F.coalesce("update_id", F.lit(0)).alias("update_id"), _integer(c("m.chat.id")).alias("chat_id"), c("m.chat.type").alias("type"),
        F.when(c("m.chat.username").rlike(r"\A[A-Za-z0-9_]{1,32}\z"), c("m.chat.username")).alias("username"),
        F.coalesce(_integer(F.coalesce("m.edit_date", "m.date")), F.lit(0)).alias("date"))
    valid = rows.filter((c("chat_id") != 0) & (c("chat_id") > -(2 ** 63) + 0) & c("type").isin(*vocab.CHAT_TYPES))
    return latest_per_key(valid, "chat_id", F.struct("date", "update_id"), "type", "username", "date", "update_id")


def _integer(text: Column) -> Column:
    """Whole JSON number, NULL for anything else."""
    return F.when(text.rlike(r"\A-?\d+\z"), text.try_cast("bigint"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document per candidate: decimals as text, timestamps with their zone."""
    text = {name: F.col(name).cast("string") for name in ("budget_min", "budget_max") if name in rows.columns}
    times = {name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ssXXX") for name in ("published_at",) if name in rows.columns}
    shown = rows.withColumns({**text, **times}) if text or times else rows
    return shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    as_json(rows).write.mode("overwrite").text(path)


def write_result(summary: DataFrame, candidates: DataFrame, path: str) -> None:
    """One run's result as JSON lines: the summary under <path>/summary, a document per candidate in candidate order under <path>/projects."""
    write_json(summary, f"{path}/summary")
    order = candidate_order()
    as_json(candidates.repartitionByRange(*order).sortWithinPartitions(*order)).write.mode("overwrite").text(f"{path}/projects")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
