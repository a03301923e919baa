"""Table schemas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MONEY = T.DecimalType(18, 2)

LISTINGS = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("budget_min", MONEY),
    T.StructField("budget_max", MONEY),
    T.StructField("currency", T.StringType()),
    T.StructField("responses_count", T.IntegerType()),
    T.StructField("views_count", T.IntegerType()),
    T.StructField("channel", T.StringType()),
    T.StructField("external_url", T.StringType()),
    T.StructField("origin_kind", T.StringType()),
    T.StructField("discovery_skip_reason", T.StringType()),
    T.StructField("publication_confirmed", T.BooleanType()),
    T.StructField("publication_evidence", T.StringType()),
    T.StructField("open_status", T.StringType()),
    T.StructField("status_evidence", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("html", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

HISTORY = T.StructType([
    T.StructField("fingerprint", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("normalized_url", T.StringType()),
    T.StructField("first_seen_at", T.TimestampType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("status", T.StringType(), False),
])

DELIVERIES = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("reserved_at", T.TimestampType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("assessment", T.StringType()),
])

# one bigint which sorts like (source, page, card): 7 bits of source, 35 of page; 21 of card hold every card of a page within the size limit
CARD_BITS, PAGE_BITS = 21, 35


def row_id(source_ord: Column, page_ord: Column, card_ord: Column) -> Column:
    """Pack a listing's lineage into one sortable BIGINT."""
    return (F.shiftleft(source_ord.cast("bigint"), CARD_BITS + PAGE_BITS)
            .bitwiseOR(F.shiftleft(page_ord.cast("bigint"), CARD_BITS))
            .bitwiseOR(card_ord.cast("bigint")))


def conform(df):
    """Bring a listings DataFrame to the fixed schema; missing columns become NULL or their default."""
    defaults = {"origin_kind": F.lit("marketplace"), "publication_confirmed": F.lit(False), "open_status": F.lit("unknown")}
    columns = []
    for f in LISTINGS.fields:
        value = F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None))
        columns.append(value.cast(f.dataType).alias(f.name))
    extra = [F.col(name) for name in df.columns if name not in LISTINGS.fieldNames()]
    return df.select(*columns, *extra)
