"""Queries over duplicates, history, logs and rendered pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import changes, dedup, history, metrics, outbox, views
from ..operators.score import moment
from ..rules import Profile
from ..schema import DELIVERIES, HISTORY
from ..session import checkpoint, shared_folder, table
from ..sources import detail, frontier, layouts, scan
from ..streaming import ingest
from .text_queries import NORM, TITLE_SQL
from .views import NOW, doc_listings, event_log, view

QUERIES, ORACLE = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


# --- duplicates among documents ------------------------------------------------------------------------------------

DOCS = f"""docs AS (SELECT doc_id AS row_id, source, text, doc_id % 3 = 0 AS post, doc_id % 6 = 0 AS linked, source || ':' || doc_id AS key, {NORM % TITLE_SQL} AS nt,
    'https://' || source || '.example.com/doc/' || (n_chars % 997) AS card, doc_id % 4 <> 0 AS confirmed,
    CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2026-09-21 12:00:00' - to_hours(doc_id % 7) END AS published_at,
    CASE WHEN doc_id % 11 = 0 THEN 'closed' WHEN doc_id % 13 = 0 THEN 'awarded' ELSE 'unknown' END AS open_status FROM documents),
  ids AS (SELECT *, CASE WHEN post THEN 'https://t.me/documents/' || row_id ELSE card END AS canonical, CASE WHEN NOT post OR linked THEN card END AS target,
    sha256(nt || E'\\n' || CASE WHEN NOT post OR linked THEN card ELSE '' END) AS fingerprint, length(nt) >= 24 AND len(string_split(nt, ' ')) >= 4 AS long FROM docs),
  edges AS (SELECT row_id, 'key' AS kind, key AS value FROM ids UNION SELECT row_id, 'fingerprint', fingerprint FROM ids WHERE NOT post OR linked OR long
    UNION SELECT row_id, 'url', canonical FROM ids),
  titles AS (SELECT nt FROM ids WHERE long GROUP BY nt HAVING count(*) > 1 AND count(DISTINCT target) <= 1 AND bool_or(post)),
  title_edges AS (SELECT row_id, 'title' AS kind, nt AS value FROM ids JOIN titles USING (nt) WHERE long)"""
COMPONENTS = f"""WITH RECURSIVE {DOCS}, every AS (SELECT * FROM edges UNION SELECT * FROM title_edges),
  near AS (SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM every a JOIN every b USING (kind, value) WHERE a.row_id <> b.row_id),
  reach AS (SELECT row_id AS node, row_id AS root FROM ids UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.node),
  comp AS (SELECT node AS row_id, min(root) AS component FROM reach GROUP BY 1)"""


@query("identity_edges", f"WITH {DOCS} SELECT * FROM edges")
def _(spark, folder) -> DataFrame:
    return dedup.identity_edges(view(doc_listings, spark, folder))


@query("title_fallback", f"WITH {DOCS} SELECT * FROM title_edges")
def _(spark, folder):
    return dedup.title_edges(view(doc_listings, spark, folder))


@query("dup_components", f"{COMPONENTS} SELECT * FROM comp")
def _(spark, folder):
    return dedup.duplicate_components(view(doc_listings, spark, folder))


SURVIVOR = f"""{COMPONENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN NOT post THEN 0 WHEN linked THEN 2 ELSE 1 END, published_at IS NULL,
    -length(text), source, CAST(row_id AS VARCHAR), row_id) AS n FROM ids JOIN comp USING (row_id)),
  safety AS (SELECT component, arg_min(open_status, row_id) FILTER (WHERE NOT post AND open_status <> 'unknown') AS closed,
    count(DISTINCT published_at) FILTER (WHERE NOT post AND confirmed) + CASE WHEN bool_or(published_at IS NULL) FILTER (WHERE NOT post AND confirmed) THEN 1 ELSE 0 END AS dates FROM r GROUP BY 1)"""


@query("survivor", f"{SURVIVOR} SELECT row_id, source FROM r WHERE n = 1")
def _(spark, folder):
    return dedup.deduplicate(view(doc_listings, spark, folder)).select("row_id", "source")


@query("safety_merge", f"""{SURVIVOR} SELECT row_id, coalesce(closed, open_status) AS open_status, confirmed AND dates <= 1 AS publication_confirmed,
  CASE WHEN dates > 1 THEN 'conflicting original publication fields' ELSE 'document' END AS publication_evidence FROM r JOIN safety USING (component) WHERE n = 1""")
def _(spark, folder):
    return dedup.deduplicate(view(doc_listings, spark, folder)).select("row_id", "open_status", "publication_confirmed", "publication_evidence")


SEQUENTIAL = f"""WITH RECURSIVE {DOCS}, keyed AS (SELECT *, row_id * 7 % 613 AS sid FROM ids),
  parents AS (SELECT *, CASE WHEN min(row_id) OVER (PARTITION BY source, sid) < row_id THEN min(row_id) OVER (PARTITION BY source, sid)
    ELSE lag(row_id) OVER (PARTITION BY source, canonical ORDER BY row_id) END AS parent FROM keyed),
  tree AS (SELECT row_id, row_id AS root FROM parents WHERE parent IS NULL UNION ALL SELECT p.row_id, t.root FROM parents p JOIN tree t ON p.parent = t.row_id),
  safety AS (SELECT root, arg_min(open_status, row_id) FILTER (WHERE NOT post AND open_status <> 'unknown') AS closed,
    count(DISTINCT published_at) FILTER (WHERE NOT post AND confirmed) + CASE WHEN bool_or(published_at IS NULL) FILTER (WHERE NOT post AND confirmed) THEN 1 ELSE 0 END AS dates
    FROM tree JOIN ids USING (row_id) GROUP BY 1)"""


@query("exact_dedup", f"""{SEQUENTIAL} SELECT row_id, coalesce(closed, open_status) AS open_status, confirmed AND NOT (dates > 1) AS publication_confirmed
  FROM safety JOIN ids ON ids.row_id = root""")
def _(spark, folder):
    """A key is shared by documents whose ids agree modulo 613, so keys and URLs bind different rows."""
    rows = view(doc_listings, spark, folder).withColumn("source_id", (c("row_id") * 7 % 613).cast("string"))
    return dedup.exact_dedup(rows.withColumn("key", F.concat_ws(":", "source", "source_id"))).select("row_id", "open_status", "publication_confirmed")


def _halves(spark, folder):
    """Even documents as history, odd ones as the batch."""
    rows = view(doc_listings, spark, folder)
    at = F.lit(NOW)
    past = history.as_record(rows.filter("row_id % 2 = 0"), at)
    status = F.when(c("row_id") % 10 == 0, "sent").when(c("row_id") % 10 == 2, "pending").otherwise("seen")
    past = past.withColumn("status", status).withColumn("sent_at", F.when(c("status") == "sent", at)).drop("row_id")
    return rows.filter("row_id % 2 = 1"), past.select(*HISTORY.fieldNames())


@query("already_seen", f"""WITH {DOCS}, past AS (SELECT * FROM ids WHERE row_id % 2 = 0 AND row_id % 10 IN (0, 2))
  SELECT row_id, EXISTS (SELECT 1 FROM past p WHERE p.fingerprint = i.fingerprint OR p.key = i.key OR p.canonical = i.canonical) AS already_seen FROM ids i WHERE row_id % 2 = 1""")
def _(spark, folder):
    batch, past = _halves(spark, folder)
    return history.mark_seen(batch, past, spark.createDataFrame([], DELIVERIES)).select("row_id", "already_seen")


@query("observe_new", f"""WITH RECURSIVE {DOCS}, past AS (SELECT * FROM ids WHERE row_id % 2 = 0),
  odd AS (SELECT *, ['f' || fingerprint, 'k' || key, 'u' || canonical] AS tags, row_number() OVER (ORDER BY row_id) AS n FROM ids i WHERE row_id % 2 = 1
    AND fingerprint NOT IN (SELECT fingerprint FROM past) AND key NOT IN (SELECT key FROM past) AND canonical NOT IN (SELECT canonical FROM past)),
  walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS tags, CAST(-1 AS BIGINT) AS row_id UNION ALL
    SELECT o.n, CASE WHEN list_has_any(w.tags, o.tags) THEN w.tags ELSE list_concat(w.tags, o.tags) END, CASE WHEN list_has_any(w.tags, o.tags) THEN -1 ELSE o.row_id END
    FROM walk w JOIN odd o ON o.n = w.n + 1)
  SELECT fingerprint, source, CAST(row_id AS VARCHAR) AS source_id, canonical AS normalized_url, 'seen' AS status FROM odd JOIN walk USING (row_id)""")
def _(spark, folder):
    batch, past = _halves(spark, folder)
    return history.new_records(batch, past, NOW).select("fingerprint", "source", "source_id", "normalized_url", "status")


# Records: one per user who viewed, found by one of 97 URLs. Picks: every click, found by its user's URL, in the order of events.
RESERVED = """rec AS (SELECT sha256('user:' || user_id) AS fingerprint, user_id % 97 AS u, min(ts) AS first_seen, CASE WHEN user_id % 251 = 0 THEN 'pending' ELSE 'seen' END AS status
    FROM events WHERE event_type = 'view' GROUP BY user_id),
  urls AS (SELECT u, bool_or(status = 'pending') AS blocked, arg_min(fingerprint, (first_seen, fingerprint)) AS earliest FROM rec GROUP BY u),
  picks AS (SELECT user_id % 97 AS u, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1),
  claims AS (SELECT p.u, p.event_id, coalesce(earliest, sha256('click:' || p.event_id)) AS fingerprint, earliest IS NULL AS fresh
    FROM picks p LEFT JOIN urls USING (u) WHERE NOT coalesce(blocked, false))"""


def _reservation(spark, folder):
    """(history, deliveries, taken, picks) after every click has tried to reserve."""
    events = table(spark, folder, "events")
    url = F.concat(F.lit("https://orders.example.com/u/"), c("user_id") % 97)
    past = events.filter("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("first_seen_at")).select(
        F.sha2(F.concat(F.lit("user:"), "user_id"), 256).alias("fingerprint"), F.lit("users").alias("source"), c("user_id").cast("string").alias("source_id"),
        url.alias("normalized_url"), "first_seen_at", F.lit(None).cast("timestamp").alias("sent_at"), F.when(c("user_id") % 251 == 0, "pending").otherwise("seen").alias("status"))
    picks = events.filter("event_type = 'click'").select(
        c("event_id").alias("row_id"), F.lit("clicks").alias("source"), c("event_id").cast("string").alias("source_id"), F.concat(F.lit("clicks:"), "event_id").alias("key"),
        F.sha2(F.concat(F.lit("click:"), "event_id"), 256).alias("fingerprint"), url.alias("url"), url.alias("canonical"), F.lit(None).cast("string").alias("direct_url"))
    return *history.reserve(past, spark.createDataFrame([], DELIVERIES), picks, NOW), picks


@query("reserve_fold", f"""WITH {RESERVED} SELECT r.fingerprint, coalesce('clicks:' || c.event_id, 'users') AS holder, CASE WHEN c.event_id IS NOT NULL THEN 'pending' ELSE status END AS status
  FROM rec r LEFT JOIN claims c USING (fingerprint) UNION ALL SELECT fingerprint, 'clicks:' || event_id, 'pending' FROM claims WHERE fresh""")
def _(spark, folder):
    records, *_ = _reservation(spark, folder)
    holder = F.when(c("source") == "users", "users").otherwise(F.concat_ws(":", "source", "source_id"))
    return records.select("fingerprint", holder.alias("holder"), "status")


@query("settle_fold", f"""WITH {RESERVED}, told AS (SELECT user_id % 97 AS u, bool_or(event_type = 'purchase' AND user_id % 3 = 0) AS sent, bool_or(event_type = 'signup' AND user_id % 5 = 0) AS unsure,
    bool_or(event_type = 'error') AS failed FROM events GROUP BY 1),
  final AS (SELECT u, event_id, fingerprint, fresh, CASE WHEN sent THEN 'sent' WHEN unsure THEN 'pending' WHEN failed THEN 'seen' ELSE 'pending' END AS status FROM claims LEFT JOIN told USING (u)),
  every AS (SELECT fingerprint, u, status FROM rec UNION ALL SELECT fingerprint, u, 'seen' FROM final WHERE fresh)
  SELECT e.fingerprint, CASE WHEN f.u IS NULL THEN e.status WHEN f.status = 'sent' THEN 'sent' WHEN f.fingerprint = e.fingerprint THEN f.status ELSE e.status END AS status,
    coalesce(f.status = 'sent', false) AS has_sent FROM every e LEFT JOIN final f ON f.u = e.u""")
def _(spark, folder):
    records, entries, taken, _ = _reservation(spark, folder)
    kind = (F.when((c("event_type") == "purchase") & (c("user_id") % 3 == 0), "sent").when((c("event_type") == "signup") & (c("user_id") % 5 == 0), "uncertain")
            .when(c("event_type") == "error", "definite"))
    outcomes = table(spark, folder, "events").select((c("user_id") % 97).alias("u"), kind.alias("outcome")).filter("outcome IS NOT NULL").distinct()
    holders = taken.select("key", F.regexp_extract("url", r"/u/(\d+)\z", 1).cast("bigint").alias("u"))
    records, _ = history.settle(records, entries, taken, outcomes.join(holders, "u").select("key", "outcome"), NOW)
    return records.select("fingerprint", "status", c("sent_at").isNotNull().alias("has_sent"))


@query("except_keys", f"WITH {DOCS} SELECT key FROM ids i WHERE row_id % 2 = 1 AND fingerprint NOT IN (SELECT fingerprint FROM ids WHERE row_id % 2 = 0)")
def _(spark, folder):
    batch, past = _halves(spark, folder)
    return batch.join(past.select("fingerprint"), "fingerprint", "left_anti").select("key")


@query("union_sources", "SELECT 'documents' AS origin, source, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'pages', lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), count(*) FROM pages GROUP BY 2")
def _(spark, folder):
    from ..functions.urls import url_host
    docs = table(spark, folder, "documents").select(F.lit("documents").alias("origin"), "source")
    pages = table(spark, folder, "pages").select(F.lit("pages").alias("origin"), url_host(c("url")).alias("source"))
    return docs.unionByName(pages).groupBy("origin", "source").agg(F.count(F.lit(1)).alias("n"))


@query("history_check", f"""WITH {DOCS}, h AS (SELECT row_id, CASE WHEN row_id % 17 = 0 THEN 'xyz' ELSE fingerprint END AS fingerprint, CASE WHEN row_id % 19 = 0 THEN 'Bad' ELSE source END AS source, canonical,
    CASE WHEN row_id % 23 = 0 THEN 'lost' WHEN row_id % 10 = 0 THEN 'sent' WHEN row_id % 10 = 2 THEN 'pending' ELSE 'seen' END AS status, row_id % 29 = 0 AS no_seen, (row_id % 10 = 0) <> (row_id % 31 = 0) AS has_sent FROM ids)
  SELECT 'invalid_fingerprint' AS rule, count(*) FILTER (WHERE fingerprint = 'xyz') AS n FROM h UNION ALL SELECT 'invalid_history_identity', count(*) FILTER (WHERE source = 'Bad') FROM h
  UNION ALL SELECT 'invalid_history_status', count(*) FILTER (WHERE status = 'lost') FROM h UNION ALL SELECT 'invalid_history_timestamp', count(*) FILTER (WHERE no_seen) FROM h
  UNION ALL SELECT 'invalid_sent_timestamp', count(*) FILTER (WHERE status = 'sent' AND NOT has_sent) FROM h UNION ALL SELECT 'unexpected_sent_timestamp', count(*) FILTER (WHERE status <> 'sent' AND has_sent) FROM h
  UNION ALL SELECT 'invalid_history_url', count(*) FILTER (WHERE row_id % 37 = 0) FROM h UNION ALL SELECT 'invalid_state_entry', count(*) FILTER (WHERE row_id % 41 = 0) FROM h
  UNION ALL SELECT 'invalid_state_status', 0 FROM (SELECT 1) UNION ALL SELECT 'invalid_state_timestamp', count(*) FILTER (WHERE row_id % 43 = 0) FROM h
  UNION ALL SELECT 'inconsistent_delivery_history', count(*) FILTER (WHERE row_id % 41 = 0 OR source = 'Bad' OR status <> 'pending' OR has_sent) FROM h
  UNION ALL SELECT 'duplicate_fingerprint', count(*) FROM (SELECT fingerprint FROM h GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_delivery', count(*) FROM (SELECT CASE WHEN row_id % 41 = 0 THEN 'x' ELSE key END AS k FROM ids GROUP BY 1 HAVING count(*) > 1)""")
def _(spark, folder):
    k = c("row_id")
    good = history.as_record(view(doc_listings, spark, folder), F.lit(NOW))
    status = F.when(k % 23 == 0, "lost").when(k % 10 == 0, "sent").when(k % 10 == 2, "pending").otherwise("seen")
    records = good.withColumns({
        "fingerprint": F.when(k % 17 == 0, "xyz").otherwise(c("fingerprint")), "source": F.when(k % 19 == 0, "Bad").otherwise(c("source")), "status": status,
        "first_seen_at": F.when(k % 29 != 0, c("first_seen_at")), "sent_at": F.when((k % 10 == 0) != (k % 31 == 0), F.lit(NOW)),
        "normalized_url": F.when(k % 37 == 0, F.concat("normalized_url", F.lit("/"))).otherwise(c("normalized_url"))})
    entries = good.select(F.when(k % 41 == 0, "x").otherwise(F.concat_ws(":", "source", "source_id")).alias("key"), "source", "source_id", F.lit("pending").alias("status"),
                          F.when(k % 43 != 0, F.lit(NOW)).alias("reserved_at"), F.lit(None).cast("timestamp").alias("sent_at"), F.lit(None).cast("string").alias("assessment"))
    return history.history_problems(records, entries)


@query("migrate_v1", """SELECT sha256('legacy:' || src || ':' || sid) AS fingerprint, src AS source, sid AS source_id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 < 3 THEN
    CASE o_orderkey % 4 WHEN 0 THEN 'https://fl.ru/projects/' WHEN 1 THEN 'https://freelance.ru/task/view/' ELSE 'https://freelance.habr.com/tasks/' END || sid END AS normalized_url,
    CASE WHEN o_orderkey % 3 = 0 THEN 'sent' ELSE 'pending' END AS status
  FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'fl_ru' WHEN 1 THEN 'freelance_ru' WHEN 2 THEN 'habr_freelance' ELSE 'weblancer' END AS src,
        CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END || o_orderkey AS sid FROM orders)""")
def _(spark, folder):
    k = c("o_orderkey")
    source = F.element_at(F.array(*map(F.lit, ("fl_ru", "freelance_ru", "habr_freelance", "weblancer"))), (k % 4 + 1).cast("int"))
    rows = table(spark, folder, "orders").select(
        source.alias("source"), F.concat(F.when(k % 5 == 0, "x").otherwise(""), k).alias("source_id"), F.when(k % 3 == 0, "sent").otherwise("pending").alias("status"),
        c("o_orderdate").alias("reserved_at"), F.when(k % 3 == 0, c("o_orderdate")).alias("sent_at"), F.lit(None).cast("string").alias("assessment"))
    moved = history.migrate_deliveries(rows.withColumn("key", F.concat_ws(":", "source", "source_id")))
    return moved.select("fingerprint", "source", "source_id", "normalized_url", "status")


# --- logs ------------------------------------------------------------------------------------------------------------

FIRST_SEEN = "SELECT user_id AS key, min(ts) AS first_seen_at FROM events GROUP BY 1"


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"


def _event_stream(spark, folder) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).select(c("user_id").alias("key"), "ts")


@query("first_seen", FIRST_SEEN)
def _(spark, folder):
    """State per key in the state store; all events come in one batch."""
    root = _scratch(spark)
    ingest.stream_first_seen(_event_stream(spark, folder), "key", "ts", f"{root}/seen", f"{root}/log")
    return spark.read.schema("key bigint, first_seen_at timestamp").parquet(f"{root}/seen")


@query("stream_ingest", FIRST_SEEN)
def _(spark, folder):
    root = _scratch(spark)
    ingest.fold_first_seen(_event_stream(spark, folder), "key", "ts", f"{root}/state", f"{root}/log")
    return ingest.read_first_seen(spark, f"{root}/state", "key")


@query("state_changes", """SELECT 'users:' || user_id AS key, arg_max(event_type, (version, event_id)) AS status, CAST(max(version) AS BIGINT) AS since
  FROM (SELECT *, event_id % 4 + 1 AS version FROM events) GROUP BY user_id HAVING NOT bool_or(version = 4 AND user_id % 5 = 0)""")
def _(spark, folder):
    """Four versions of changes, one per remainder of the event; the first two are folded; in the last, one user in five goes."""
    root, events = _scratch(spark), table(spark, folder, "events")
    for version in range(1, 5):
        last = events.filter(c("event_id") % 4 + 1 == version).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))
        rows = last.select(F.concat(F.lit("users:"), "user_id").alias("key"), F.lit("users").alias("source"), c("user_id").cast("string").alias("source_id"), "status",
                           F.lit(None).cast("timestamp").alias("reserved_at"), F.lit(None).cast("timestamp").alias("sent_at"), F.lit(None).cast("string").alias("assessment"),
                           (F.lit(version == 4) & (c("user_id") % 5 == 0)).alias("gone"))
        changes.append(rows, root, changes.ENTRIES, version)
    changes.fold(spark, root, changes.ENTRIES, 2)
    changes.expire(spark, root, changes.ENTRIES, 2)
    return changes.Store(spark, root).entries().select("key", "status", "since")


@query("indexed_seen", f"""WITH {DOCS}, past AS (SELECT * FROM ids WHERE row_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY row_id) = 1),
  shut AS (SELECT * FROM past WHERE row_id % 10 IN (0, 2))
  SELECT row_id, EXISTS (SELECT 1 FROM shut p WHERE p.fingerprint = i.fingerprint OR p.key = i.key OR p.canonical = i.canonical) AS already_seen FROM ids i WHERE row_id % 2 = 1""")
def _(spark, folder):
    """The history, one record per fingerprint, is kept as changes and looked up by the identities of the batch."""
    batch, past = _halves(spark, folder)
    records = past.groupBy("fingerprint").agg(F.min_by(F.struct(*HISTORY.fieldNames()), c("source_id").cast("bigint")).alias("r")).select("r.*")
    nothing, none = spark.createDataFrame([], HISTORY), spark.createDataFrame([], DELIVERIES)
    store = changes.Store(spark, _scratch(spark))
    store.commit((nothing, none), (records, none), 1)
    batch = checkpoint(batch)
    return history.mark_seen(batch, store.matching(history.listing_identities(batch).select("kind", "value")), none).select("row_id", "already_seen")


@query("state_fold", """WITH a AS (SELECT user_id AS key, ts, event_id, CASE event_type WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'release' ELSE 'observe' END AS action FROM events),
  b AS (SELECT *, last_value(CASE action WHEN 'reserve' THEN true WHEN 'release' THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_before FROM a),
  f AS (SELECT key, min(ts) FILTER (WHERE action IN ('observe', 'reserve')) AS first_seen_at, min(ts) FILTER (WHERE action = 'sent' AND open_before) AS sent_at,
    arg_max(action, (ts, event_id)) FILTER (WHERE action IN ('reserve', 'release')) AS last FROM b GROUP BY 1)
  SELECT key, CASE WHEN sent_at IS NOT NULL THEN 'sent' WHEN last = 'reserve' THEN 'pending' ELSE 'seen' END AS status, first_seen_at, sent_at FROM f WHERE first_seen_at IS NOT NULL""")
def _(spark, folder):
    return history.fold_state(view(event_log, spark, folder))


@query("retention", """WITH d AS (SELECT event_id, ts, event_type = 'purchase' AS sent FROM events WHERE event_type = 'purchase' OR (event_type = 'signup' AND event_id % 10 = 0)),
  n AS (SELECT count(*) AS total FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY sent ORDER BY ts, 'events:' || event_id) AS age FROM d)
  SELECT 'events:' || event_id AS key, CASE WHEN sent THEN 'sent' ELSE 'pending' END AS status FROM r, n WHERE NOT sent OR age > total + 1 - total // 2""")
def _(spark, folder):
    rows = table(spark, folder, "events").filter("event_type = 'purchase' OR (event_type = 'signup' AND event_id % 10 = 0)")
    sent = c("event_type") == "purchase"
    deliveries = rows.select(F.concat(F.lit("events:"), "event_id").alias("key"), F.lit("events").alias("source"), c("event_id").cast("string").alias("source_id"),
                             F.when(sent, "sent").otherwise("pending").alias("status"), c("ts").alias("reserved_at"), F.when(sent, c("ts")).alias("sent_at"),
                             F.lit(None).cast("string").alias("assessment"))
    return history.retain(deliveries, rows.count() // 2).select("key", "status")


@query("latest_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, folder):
    return views.latest_per_key(table(spark, folder, "events"), "user_id", F.struct("ts", "event_id"), "event_id", "event_type")


@query("latest_chats", """SELECT chat_id, type, username, date, update_id FROM (SELECT user_id AS chat_id, CASE WHEN user_id % 2 = 0 THEN 'private' ELSE 'group' END AS type,
    CASE WHEN user_id % 5 <> 0 THEN 'user_' || user_id END AS username, CAST(floor(epoch(ts)) AS BIGINT) AS date, event_id AS update_id,
    row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) DESC, event_id DESC) AS n FROM events WHERE user_id <> 0 AND event_type <> 'signup' AND user_id % 7 <> 0) WHERE n = 1""")
def _(spark, folder):
    kind = (F.when(c("event_type") == "view", "message").when(c("event_type") == "click", "edited_message").when(c("event_type") == "purchase", "channel_post")
            .when(c("event_type") == "error", "business_message").otherwise("poll"))
    name = F.when(c("user_id") % 5 == 0, F.lit("no name")).otherwise(F.concat(F.lit("user_"), c("user_id")))
    chat_type = F.when(c("user_id") % 7 == 0, "robot").when(c("user_id") % 2 == 0, "private").otherwise("group")
    at = F.unix_seconds(c("ts").cast("timestamp")).cast("string")
    text = F.concat(F.lit('{"update_id": '), c("event_id"), F.lit(', "'), kind, F.lit('": {"date": 1, "edit_date": '), at, F.lit(', "chat": {"id": '), c("user_id"),
                    F.lit(', "type": "'), chat_type, F.lit('", "username": "'), name, F.lit('"}}}'))
    return scan.latest_chats(table(spark, folder, "events").select(text.alias("value")))


FETCH = """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE [200, 404, 503, 403, 301][CAST(event_id % 6 + 1 AS INTEGER)] END AS status, event_id % 4 = 0 AS robots,
    CASE WHEN event_id % 7 = 0 THEN 'application/json' WHEN event_id % 4 = 0 THEN 'text/plain' ELSE 'Text/HTML; charset=utf-8' END AS kind, CAST(floor(value * 60000) AS BIGINT) AS n_bytes, value AS seconds FROM events"""


@query("crawl_class", f"""SELECT event_id, CASE WHEN status IS NULL THEN 'network_error' WHEN robots AND status = 404 THEN NULL WHEN status = 503 THEN 'temporary_http_error' WHEN status = 403 THEN 'access_restricted'
    WHEN status <> 200 THEN 'unexpected_http_status' WHEN kind = 'application/json' THEN 'unexpected_content_type' WHEN n_bytes > CASE WHEN robots THEN 262144 ELSE 2097152 END THEN 'response_too_large'
    WHEN seconds > 45 THEN 'response_deadline_exceeded' END AS error FROM ({FETCH})""")
def _(spark, folder):
    k = c("event_id")
    status = F.when(k % 6 != 5, F.element_at(F.array(*map(F.lit, (200, 404, 503, 403, 301, 0))), (k % 6 + 1).cast("int")))
    kind = F.when(k % 7 == 0, "application/json").when(k % 4 == 0, "text/plain").otherwise("Text/HTML; charset=utf-8")
    error = frontier.fetch_error(status, kind, F.floor(c("value") * 60000), c("value"), k % 4 == 0)
    return table(spark, folder, "events").select("event_id", error.alias("error"))


@query("stop_after", """WITH l AS (SELECT user_id AS source, event_id AS seq, event_id % 3 + 1 AS page_no, CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'access_restricted'
    WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'robots_disallowed' END AS error FROM events),
  w AS (SELECT *, coalesce(bool_or(coalesce(error = 'access_restricted', false)) OVER p, false) AS stopped, coalesce(bool_or(coalesce(error = 'robots_disallowed' AND page_no > 1, false)) OVER p, false) AS blocked
    FROM l WINDOW p AS (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT source, seq, page_no, error FROM w WHERE NOT stopped AND NOT (page_no > 1 AND blocked)""")
def _(spark, folder):
    error = F.when((c("event_type") == "error") & (c("event_id") % 4 == 0), "access_restricted").when((c("event_type") == "click") & (c("event_id") % 5 == 0), "robots_disallowed")
    log = table(spark, folder, "events").select(c("user_id").alias("source"), c("event_id").alias("seq"), (c("event_id") % 3 + 1).alias("page_no"), error.alias("error"))
    return frontier.stop_after_restriction(log)


@query("source_status", """WITH p AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS good, count(*) FILTER (WHERE event_type = 'error') AS bad,
    arg_min('code_' || (event_id % 3), event_id) FILTER (WHERE event_type = 'error') AS first_error FROM events GROUP BY 1)
  SELECT user_id AS source, CASE WHEN user_id % 10 = 0 THEN 'disabled' WHEN good = 0 AND bad > 0 THEN 'error' WHEN bad > 0 THEN 'partial' ELSE 'ok' END AS status, first_error FROM p""")
def _(spark, folder):
    code = F.when(c("event_type") == "error", F.concat(F.lit("code_"), c("event_id") % 3))
    log = table(spark, folder, "events").select(c("user_id").alias("source"), c("event_id").alias("seq"), code.alias("error"), F.lit(0).alias("parse_errors"), F.lit(0).alias("filtered_count"))
    found = metrics.page_metrics(log)
    return found.select("source", metrics.source_status(c("source") % 10 != 0, c("pages_fetched"), c("failed_pages")).alias("status"), "first_error")


@query("error_counts", "SELECT user_id AS source, 'code_' || (event_id % 3) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def _(spark, folder):
    code = F.when(c("event_type") == "error", F.concat(F.lit("code_"), c("event_id") % 3))
    log = table(spark, folder, "events").select(c("user_id").alias("source"), c("event_id").cast("string").alias("url"), code.alias("error"))
    return metrics.error_counts(log).select("source", F.explode("errors").alias("error", "n"))


@query("send_prefix", """WITH a AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), w AS (SELECT *, coalesce(sum(ok::INT) OVER p, 0) AS done, coalesce(bool_or(NOT ok) OVER p, false) AS failed FROM a
    WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, event_id AS position, ok FROM w WHERE done < 3 AND NOT failed""")
def _(spark, folder):
    attempts = table(spark, folder, "events").select("user_id", c("event_id").alias("position"), (c("event_type") != "error").alias("ok"))
    return outbox.send_prefix(attempts, "user_id", 3)


@query("outcome_class", """WITH o AS (SELECT event_id, event_id % 10 AS v, CAST(user_id % 3 AS INTEGER) AS attempt, CAST(floor(value) AS BIGINT) AS wait FROM events)
  SELECT event_id, CASE v WHEN 0 THEN NULL WHEN 1 THEN 'telegram_rate_limited' WHEN 2 THEN 'telegram_rejected' WHEN 3 THEN 'telegram_delivery_uncertain' WHEN 4 THEN 'telegram_invalid_response'
    WHEN 5 THEN 'telegram_missing_confirmation' WHEN 6 THEN 'telegram_connection_failed' WHEN 7 THEN 'telegram_delivery_uncertain' WHEN 8 THEN 'telegram_response_too_large' ELSE 'telegram_response_deadline' END AS code,
    CASE WHEN v = 0 THEN 'sent' WHEN v = 1 THEN CASE WHEN attempt < 2 AND wait <= 30 THEN 'retry' ELSE 'definite' END WHEN v = 2 THEN 'definite' WHEN v = 6 THEN CASE WHEN attempt < 2 THEN 'retry' ELSE 'definite' END
      ELSE 'uncertain' END AS outcome FROM o""")
def _(spark, folder):
    v = c("event_id") % 10
    body = (F.when(v == 0, '{"ok": true, "result": {"message_id": 7}}').when(v == 1, F.concat(F.lit('{"ok": false, "error_code": 429, "parameters": {"retry_after": '), F.floor("value"), F.lit("}}")))
            .when(v == 2, '{"ok": false, "error_code": 400}').when(v == 3, '{"ok": false}').when(v == 4, "<html>").when(v == 5, '{"ok": true, "result": {}}').otherwise('{"ok": true}'))
    status = F.when(v == 1, 429).when(v == 2, 400).when(v == 3, 502).otherwise(200)
    failure = F.when(v == 6, "connect").when(v == 7, "read")
    rows = table(spark, folder, "events").select("event_id", (c("user_id") % 3).cast("int").alias("attempt"), failure.alias("failure"), status.alias("http_status"), body.alias("body"),
                                                 F.when(v == 8, 70000).otherwise(100).alias("reply_bytes"), F.when(v == 9, 46.0).otherwise(1.0).alias("read_seconds"), F.lit(None).cast("string").alias("retry_after"))
    return outbox.classify_outcomes(rows, NOW).select("event_id", "code", "outcome")


@query("first_n_per_group", "SELECT l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem) WHERE rank <= 2")
def _(spark, folder):
    order = [F.asc(name) for name in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return views.first_per_group(table(spark, folder, "lineitem"), "l_orderkey", order, 2).select("l_orderkey", "l_linenumber", "rank")


# --- pages rendered from orders, read back by the layouts --------------------------------------------------------------

def rendered_pages(spark, folder, source: str, card, around=("<html><body>", "</body></html>")) -> DataFrame:
    """Listing pages of twenty orders each."""
    rows = table(spark, folder, "orders").select(F.floor(c("o_orderkey") / 20).cast("bigint").alias("seq"), "o_orderkey", card.alias("card"))
    pages = rows.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "card"))), lambda x: x["card"]), "\n").alias("cards"))
    return pages.select(F.lit(source).alias("source"), F.concat(F.lit("page-"), "seq").alias("url"), F.lit(1).alias("page_no"), "seq",
                        F.concat(F.lit(around[0]), "cards", F.lit(around[1])).alias("html"))


ALL = Profile(disabled_sources=(), channels=("orders_feed",))
PRICE = "CAST(floor(o_totalprice) AS BIGINT)"


def _extracted(spark, folder, source, card, *columns, around=("<html><body>", "</body></html>")):
    rows = layouts.extract(rendered_pages(spark, folder, source, card, around), layouts.LAYOUTS[source], NOW, ALL)
    return rows.select("seq", "card_ord", "card_state", *columns)


PLACE = "o_orderkey // 20 AS seq, CAST(o_orderkey % 20 AS INTEGER) AS card_ord"


@query("extract_habr", f"""SELECT {PLACE}, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid' ELSE 'ok' END AS card_state, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS source_id, 'Заказ ' || o_orderkey || ' & ко' AS title,
    {PRICE} AS amount, CAST(o_custkey % 50 AS INTEGER) AS responses_count, o_orderdate + INTEGER '9' * INTERVAL 1 HOUR AS published_at, o_orderpriority || ' tag' AS category FROM orders""")
def _(spark, folder):
    k = c("o_orderkey")
    card = F.concat(F.lit('<article class="task card"><div class="task__title"><a href="/'), F.when(k % 7 == 0, "users/").otherwise("tasks/"), k, F.lit('">Заказ '), k, F.lit(" &amp; ко</a></div>"),
                    F.lit('<div class="task__price">'), F.floor("o_totalprice"), F.lit(' руб.</div><span class="params__responses"> '), c("o_custkey") % 50, F.lit(' откликов</span><ul class="task__tags"><li>'),
                    c("o_orderpriority"), F.lit('<li>tag</ul><time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T12:00:00+03:00">вчера</time></article>'))
    return _extracted(spark, folder, "habr_freelance", card, "source_id", "title", c("budget_min").cast("bigint").alias("amount"), "responses_count", "published_at", "category")


@query("extract_fl", f"""SELECT {PLACE}, CASE WHEN o_orderkey % 5 = 0 THEN 'filtered' WHEN o_orderkey % 11 = 0 THEN 'invalid' ELSE 'ok' END AS card_state, 'Заказ ' || o_orderkey AS title, {PRICE} AS amount,
    CAST(o_custkey % 50 AS INTEGER) AS responses_count, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'unknown' END AS open_status, TIMESTAMP '2026-09-21 12:00:00' - to_minutes(o_orderkey % 600) AS published_at,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Программирование' END AS category FROM orders""")
def _(spark, folder):
    k = c("o_orderkey")
    card = F.concat(F.lit('<div class="b-post '), F.when(k % 3 == 0, "topprjpay").otherwise(""), F.lit('" id="project-item'), k, F.lit('"><h2><a href="'), F.when(k % 11 == 0, "https://evil.example").otherwise(""),
                    F.lit("/projects/"), k, F.lit('/zakaz.html">Заказ '), k, F.lit('</a></h2><div class="b-post__price">от '), F.floor("o_totalprice"), F.lit(' ₽</div><div class="b-post__body"><p class="b-post__txt">Текст'),
                    F.lit('</p></div><div class="b-post__foot"><b class="b-post__bold">'), F.when(k % 5 == 0, "Вакансия").otherwise("Заказ"), F.lit('</b><span class="text-gray-opacity-4">'), F.floor(k % 600 / 60), F.lit(" часов "), k % 60,
                    F.lit(' минут назад</span><span><i title="Количество ответов"></i>'), c("o_custkey") % 50, F.lit("</span></div>"),
                    F.when(c("o_orderstatus") == "F", '<span data-id="qa-order-status">Заказ закрыт</span>').otherwise(""), F.lit("</div>"))
    around = ("<html><head><title>Заказы</title></head><body><h1>Программирование</h1>", "</body></html>")
    return _extracted(spark, folder, "fl_ru", card, "title", c("budget_min").cast("bigint").alias("amount"), "responses_count", "open_status", "published_at", "category", around=around)


@query("extract_freelance", f"""SELECT {PLACE}, CASE WHEN o_orderkey % 6 = 0 THEN 'ignored' ELSE 'ok' END AS card_state, CAST(o_orderkey AS VARCHAR) AS source_id, 'Описание Срок: 3 дня Опыт: 2 года' AS description,
    {PRICE} AS amount, CAST(o_custkey % 50 AS INTEGER) AS responses_count, CAST(o_custkey AS INTEGER) AS views_count, o_orderdate + INTERVAL 7 HOUR AS published_at,
    CASE WHEN o_orderstatus = 'F' THEN 'awarded' ELSE 'unknown' END AS open_status, 'Веб / ' || o_orderpriority AS category FROM orders""")
def _(spark, folder):
    k = c("o_orderkey")
    card = F.concat(F.lit('<article class="task-card'), F.when(k % 6 == 0, " task-card--premium").otherwise(""), F.lit('"><a class="task-card__title-link" href="/task/view/'), k, F.lit('">Заказ</a><div class="task-card__desc">Описание</div>'),
                    F.lit('<div class="task-card__meta-rows">Срок: <b>3 дня</b></div><div class="task-card__chips"><i class="task-chip">Веб</i><i class="task-chip">'), c("o_orderpriority"), F.lit('</i></div><div class="task-card__budget">до '),
                    F.floor("o_totalprice"), F.lit(' руб.</div><div class="task-card__foot"><span class="task-card__foot-item" title="'), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(' 10:00"><i class="fa-clock-o"></i></span>'),
                    F.lit('<span class="task-card__foot-item"><i class="fa-comments"></i>'), c("o_custkey") % 50, F.lit('</span><span class="task-card__foot-item"><i class="fa-eye"></i> '), c("o_custkey"),
                    F.lit('</span><span class="task-card__foot-item">Опыт: 2 года</span></div>'), F.when(c("o_orderstatus") == "F", '<span class="task-badge">Исполнитель выбран</span>').otherwise(""), F.lit("</article>"))
    return _extracted(spark, folder, "freelance_ru", card, "source_id", "description", c("budget_max").cast("bigint").alias("amount"), "responses_count", "views_count", "published_at", "open_status", "category")


@query("extract_weblancer", f"""SELECT {PLACE}, CASE WHEN o_orderkey % 9 = 0 THEN 'invalid' ELSE 'ok' END AS card_state, {PRICE} AS amount, CAST(o_custkey AS INTEGER) AS views_count, CAST(o_custkey % 50 AS INTEGER) AS responses_count,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Копирайтинг, Тег' ELSE 'raznoe, Тег' END AS category FROM orders""")
def _(spark, folder):
    k = c("o_orderkey")
    href = F.when(k % 9 == 0, F.concat(F.lit("javascript:go("), k, F.lit(")"))).otherwise(F.concat(F.lit("/freelance/"), F.when(k % 2 == 0, "kopiraiting").otherwise("raznoe"), F.lit("-4/zakaz-"), k, F.lit("/")))
    card = F.concat(F.lit('<article><div><h2><a href="'), href, F.lit('">Заказ</a></h2><span class="whitespace-nowrap">'), F.floor("o_totalprice"), F.lit(" <!-- x --> $</span></div><p>Текст 5 руб</p><span>01.02.2026</span><span>"),
                    c("o_custkey"), F.lit(" просмотров</span><span>"), c("o_custkey") % 50, F.lit(' заявок</span><a href="/freelance/teg/">Тег</a></article>'))
    return _extracted(spark, folder, "weblancer", card, c("budget_max").cast("bigint").alias("amount"), "views_count", "responses_count", F.when(c("card_state") == "ok", c("category")).alias("category"))


@query("extract_posts", f"""SELECT {PLACE}, CASE WHEN o_orderkey % 8 = 7 THEN 'invalid' WHEN o_orderkey % 6 = 5 THEN 'filtered' ELSE 'ok' END AS card_state,
    CASE WHEN o_orderkey % 6 <> 5 THEN 'Заказ ' || o_orderkey END AS title, CASE WHEN o_orderkey % 6 <> 5 THEN {PRICE} END AS amount,
    CASE WHEN o_orderkey % 6 <> 5 AND o_orderkey % 4 = 0 THEN 'https://freelance.ru/task/view/' || o_orderkey WHEN o_orderkey % 6 <> 5 THEN 'https://site.example/brief' END AS external_url,
    CASE WHEN o_orderkey % 6 = 5 THEN 'direct_post' ELSE 'repost' END AS origin_kind, o_orderdate + INTERVAL 10 HOUR AS published_at FROM orders""")
def _(spark, folder):
    k = c("o_orderkey")
    text = F.concat(F.lit('<div class="tgme_widget_message_text">#заказ #код<br>Заказ '), k, F.lit("<br>Бюджет: "), F.floor("o_totalprice"), F.lit(' ₽<br><a href="https://t.me/person">автор</a><a href="https://site.example/brief">бриф</a>'),
                    F.when(k % 4 == 0, F.concat(F.lit('<a href="https://freelance.ru/task/view/'), k, F.lit('">заказ</a>'))).otherwise(""), F.lit("</div>"))
    card = F.concat(F.lit('<div class="tgme_widget_message" data-post="'), F.when(k % 8 == 7, "Strangers").otherwise("Orders_feed"), F.lit("/"), k, F.lit('">'), F.when(k % 6 == 5, "<i>фото</i>").otherwise(text),
                    F.lit('<a class="tgme_widget_message_date"><time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T12:00:00+02:00"></time></a></div>'))
    return _extracted(spark, folder, "telegram_public", card, F.nullif("title", F.lit("")).alias("title"), c("budget_min").cast("bigint").alias("amount"), "external_url", "origin_kind", "published_at")


@query("detail_enrich", """SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 13 = 0 THEN 'unrecognized_project_card' END AS card_error,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 11 HOUR END AS confirmed_at, CASE WHEN o_orderstatus = 'F' THEN 'not_accepting' END AS closed, o_orderkey % 4 <> 0 AS reply_open FROM orders""")
def _(spark, folder):
    k = c("o_orderkey")
    stamp = F.concat(F.lit('<p class="text-10 opacity-50">Опубликован '), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" в 14:00</p>"))
    page = F.concat(F.lit('<html><body><div id="projectp'), F.when(k % 13 == 0, F.lit("x")).otherwise(""), k, F.lit('">закрыт</div>'), stamp, F.when(k % 5 == 0, stamp).otherwise(""),
                    F.when(c("o_orderstatus") == "F", "<div>Отклики не принимаются</div>").otherwise("<div>Ждём</div>"), F.lit("<form"), F.when(k % 4 == 0, ' style="display: none"').otherwise(""),
                    F.lit('><button id="reply_offer">Ответить</button></form></body></html>'))
    pages = table(spark, folder, "orders").select(F.lit("fl_ru").alias("source"), k.cast("string").alias("source_id"), page.alias("html"))
    return detail.read_cards(pages, F.lit(NOW)).select("source_id", "card_error", "confirmed_at", "closed", "reply_open")


@query("next_page", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN 'https://www.fl.ru/projects/category/c' || o_orderkey || '/page-' || (o_orderkey % 3 + 2) || '/' END AS url FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 4 < 3""")
def _(spark, folder):
    k = c("o_orderkey")
    root = F.concat(F.lit("https://www.fl.ru/projects/category/c"), k, F.lit("/"))
    url = F.concat(root, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("page-"), k % 3 + 1, F.lit("/"))))
    target = F.concat(F.when(k % 4 == 3, F.lit("https://evil.example")).otherwise(""), F.lit("/projects/category/c"), k, F.lit("/page-"), k % 3 + 2, F.lit("/"))
    page = F.concat(F.lit('<a href="/x">x</a><a href="'), target, F.lit('#top">2</a><a href="/projects/category/c0/page-9/">9</a>'))
    pages = table(spark, folder, "orders").select(F.lit("fl_ru").alias("source"), url.alias("url"), (k % 3 + 1).cast("int").alias("page_no"), k.alias("seq"), page.alias("html"))
    found = frontier.next_pages(pages)
    return found.select(F.regexp_extract("url", r"/c(\d+)/", 1).cast("bigint").alias("o_orderkey"), "url")
