"""What to read next: seeds, robots rules, crawl delays, fetch log classes, stop rules, pagination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import vocab
from ..functions.urls import safe_url, url_host, url_path, url_query
from ..operators.skew import matched_groups, spread_join
from ..rules import Profile
from ..session import checkpoint
from .html import attribute, find_all, tag, with_page

RULE_KEYS = ("allow", "disallow", "crawl-delay", "request-rate")
PAGINATED = {"fl_ru": 3, "freelance_ru": 3}


def seeds(spark: SparkSession, profile: Profile = Profile(), terms: DataFrame | None = None) -> DataFrame:
    """(source, url, ord): listing URLs to start from, each URL once at its first position.

    `terms`(ord, term) replaces the built-in search terms of the search form, for example by a table.
    """
    fixed = [("freelance_ru", vocab.SOURCE_BASE_URLS["freelance_ru"], -1), ("habr_freelance", vocab.SOURCE_BASE_URLS["habr_freelance"], 0),
             ("weblancer", vocab.SOURCE_BASE_URLS["weblancer"], 0)]
    fixed += [("fl_ru", url, i) for i, url in enumerate(vocab.SEED_CATEGORY_URLS)]
    fixed += [("telegram_public", vocab.CHANNEL_PREFIX + name, i) for i, name in enumerate(profile.channels)]
    if terms is None:
        terms = spark.createDataFrame(list(enumerate(vocab.SEARCH_TERMS)), "ord bigint, term string")
    searches = terms.select(F.lit("freelance_ru").alias("source"), F.concat(F.lit(vocab.SEARCH_PREFIX), form_value(F.col("term"))).alias("url"),
                            F.col("ord").cast("bigint").alias("ord"))
    known = spark.createDataFrame(fixed, "source string, url string, ord bigint")
    enabled = known.unionByName(searches).filter(~F.col("source").isin(*profile.disabled_sources, ""))
    return enabled.groupBy("source", "url").agg(F.min("ord").alias("ord"))


def form_value(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


# --- robots ----------------------------------------------------------------------------------------------------

def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, pos, key, value) of the rule groups which apply to `agent`, from a table of (host, text).

    The groups with the longest matching agent name apply, '*' counts as length 0, and equal groups are merged. A host's
    file is small by contract (256 KiB), so its lines fit one window partition.
    """
    c = F.col
    bot = agent.split("/", 1)[0].lower()
    lines = robots.select("host", F.posexplode(F.split("text", r"\r\n|[\r\n\x0b\x0c]")).alias("pos", "line"))
    body = lines.withColumn("line", F.trim(F.regexp_extract("line", r"\A([^#]*)", 1))).filter(c("line").contains(":"))
    named = body.select("host", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"),
                        F.trim(F.regexp_extract("line", r"(?s)\A[^:]*:(.*)\z", 1)).alias("value"))
    relevant = named.filter(c("key").isin("user-agent", *RULE_KEYS)).withColumn("_agent", c("key") == "user-agent")
    order = Window.partitionBy("host").orderBy("pos")
    starts = c("_agent") & ~F.coalesce(F.lag("_agent").over(order), F.lit(False))
    grouped = relevant.withColumn("_start", starts.cast("int")).withColumn("_group", F.sum("_start").over(order)).filter(c("_group") > 0)
    name = F.lower("value")
    rank = F.when(c("_agent") & (name == "*"), 0).when(c("_agent") & F.lit(bot).contains(name), F.length("value"))
    # all windows share the partitioning by host: one shuffle
    ranked = grouped.withColumn("_rank", F.max(rank).over(Window.partitionBy("host", "_group")))
    judged = ranked.withColumn("_best", F.max("_rank").over(Window.partitionBy("host")))
    return judged.filter(~c("_agent") & (c("_rank") == c("_best"))).select("host", "pos", "key", "value")


def rules_by_stem(rules: DataFrame) -> DataFrame:
    """(host, stem, size, allow, wild): path rules by the literal text they start with. size and allow are those of the rule that is
    nothing but this text, NULL without one; `wild` holds the rules with wildcards or an end mark behind it, with ready patterns."""
    c = F.col
    path_rules = rules.filter(c("key").isin("allow", "disallow") & (c("value") != ""))
    ends = c("value").endswith("$")
    body = F.when(ends, F.expr("substring(value, 1, length(value) - 1)")).otherwise(c("value"))
    quoted = F.array_join(F.transform(F.split(body, r"\*"), lambda s: F.concat(F.lit(r"\Q"), s, F.lit(r"\E"))), ".*")
    wild = ends | c("value").contains("*")
    size = F.length(F.regexp_replace(F.replace("value", F.lit("*"), F.lit("")), r"\$+\z", ""))
    allow = c("key") == "allow"
    pattern = F.concat(F.lit(r"\A"), quoted, F.when(ends, r"\z").otherwise(""))
    return path_rules.groupBy("host", F.substring_index(body, "*", 1).alias("stem")).agg(
        F.max(F.when(~wild, size)).alias("size"), F.max(F.when(~wild, allow)).alias("allow"),
        F.collect_set(F.when(wild, F.struct(size.alias("size"), allow.alias("allow"), pattern.alias("pattern")))).alias("wild"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `allowed` to rows with `url`: the longest matching rule decides, allow wins ties, no match allows.

    Each distinct path is judged once. It is cut at the lengths that stems of its host have, and each cut meets the rules of its stem
    in a join, so the work per path follows its length and not the number of rules; only wildcard rules of a stem that the path starts
    with are tried one by one. All three joins spread hosts, stems and paths that hold many rows; what a join reads several times is
    checkpointed.
    """
    c = F.col
    query = url_query(c("url"))
    # a host without a name keeps its NULL key, which spread_join distributes
    rows = urls.withColumns({"_host": F.nullif(url_host(c("url")), F.lit("")),
                             "_path": F.concat(url_path(c("url")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))})
    stems = checkpoint(rules_by_stem(rules).withColumnRenamed("host", "_host"))
    lengths = stems.groupBy("_host").agg(F.collect_set(F.length("stem")).alias("_lengths"))
    paths = rows.filter(c("_host").isNotNull() & c("_path").isNotNull()).groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n"))
    hosts = paths.groupBy("_host").agg(F.count(F.lit(1)).alias("_paths")).join(lengths, "_host")
    ruled = spread_join(paths, hosts, ["_host"], "_paths", c("_path"), "inner")
    cut = checkpoint(ruled.select("_host", "_path", "_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_size")).select(
        "_host", "_path", "_n", F.expr("substring(_path, 1, _size)").alias("stem")))
    probes = matched_groups(cut, stems, ["_host", "stem"], "_cuts")
    met = spread_join(cut, probes, ["_host", "stem"], "_cuts", c("_path"), "inner")
    fits = F.filter("wild", lambda r: F.rlike(c("_path"), r["pattern"]))
    plain = F.when(c("size").isNotNull(), F.struct("size", "allow"))
    best = F.greatest(plain, F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow")))))
    judged = checkpoint(met.withColumn("_best", best).filter(c("_best").isNotNull()).groupBy("_host", "_path").agg(
        F.max("_best").alias("_best"), F.max("_n").alias("_n")))
    joined = spread_join(rows, judged, ["_host", "_path"], "_n", c("url"))
    return joined.withColumn("allowed", F.coalesce(c("_best.allow"), F.lit(True))).select(*urls.columns, "allowed")


def crawl_delays(rules: DataFrame) -> DataFrame:
    """(host, delay_seconds, refused): the largest stated delay, at least two seconds; beyond a minute a host is not read."""
    c = F.col
    number = lambda v: F.when(~F.isnan(v.try_cast("double")), v.try_cast("double"))
    requests, seconds = number(F.substring_index("value", "/", 1)), number(F.regexp_extract("value", r"(?s)\A[^/]*/(.*)\z", 1))
    stated = F.when(c("key") == "crawl-delay", number(c("value"))).when(c("key") == "request-rate", F.try_divide(seconds, requests))
    delay = F.greatest(F.lit(vocab.MIN_CRAWL_DELAY), F.max(stated))
    return rules.groupBy("host").agg(delay.alias("delay_seconds")).withColumn("refused", c("delay_seconds") > vocab.MAX_CRAWL_DELAY)


# --- fetch log -------------------------------------------------------------------------------------------------

def fetch_error(status: Column, content_type: Column, n_bytes: Column, read_seconds: Column, robots: Column,
                delay: Column | None = None) -> Column:
    """Fixed code of a stored fetch, NULL if its body may be used."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    holds = lambda names: reduce(lambda a, b: a | b, (kind.contains(n) for n in names))
    absent = robots & status.isin(*vocab.ROBOTS_ABSENT_STATUSES)
    refused = F.lit(False) if delay is None else F.coalesce(delay > vocab.MAX_CRAWL_DELAY, F.lit(False))
    cap = F.when(robots, vocab.MAX_ROBOTS_BYTES).otherwise(vocab.MAX_PAGE_BYTES)
    typed = F.when(robots, holds(vocab.ROBOTS_CONTENT_TYPES)).otherwise(holds(vocab.PAGE_CONTENT_TYPES))
    return (F.when(refused, "crawl_delay_exceeds_run_budget").when(status.isNull(), "network_error")
            .when(absent, F.lit(None).cast("string"))
            .when(status.isin(*vocab.TEMPORARY_STATUSES), "temporary_http_error")
            .when(status.isin(*vocab.RESTRICTED_STATUSES), "access_restricted")
            .when(status != 200, "unexpected_http_status").when(~typed, "unexpected_content_type")
            .when(n_bytes > cap, "response_too_large").when(read_seconds > vocab.MAX_READ_SECONDS, "response_deadline_exceeded"))


def stop_after_restriction(log: DataFrame) -> DataFrame:
    """Rows of (source, seq, page_no, error, ...) a run would have reached.

    Nothing is read after a source's first restriction; a robots refusal beyond page 1 only ends the pagination. Both
    positions are aggregates per source, joined back without collecting a source in one task.
    """
    c = F.col
    refused_page = (c("page_no") > 1) & (c("error") == "robots_disallowed")
    ends = log.groupBy("source").agg(
        F.min(F.when(c("error").isin(*vocab.STOP_CODES), c("seq"))).alias("_stop"),
        F.min(F.when(refused_page, c("seq"))).alias("_blocked"), F.count(F.lit(1)).alias("_n"))
    placed = spread_join(log, ends, ["source"], "_n", c("seq"), "inner")
    blocked = (c("page_no") > 1) & (c("seq") > c("_blocked"))
    reached = (c("_stop").isNull() | (c("seq") <= c("_stop"))) & ~F.coalesce(blocked, F.lit(False))
    return placed.filter(reached).select(*log.columns)


# --- links -----------------------------------------------------------------------------------------------------

def page_links(pages: DataFrame, key: str = "url") -> DataFrame:
    """(key, pos, href): links of each page in document order."""
    links = F.transform(find_all(tag("a", href=None)), lambda n: attribute(n, "href"))
    return with_page(pages, key).select(key, F.posexplode(links).alias("pos", "href"))


def _filters(query: Column) -> Column:
    """Comparable filter parameters of a search URL: no page number, indexed names unified, blanks dropped, sorted."""
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(
        F.regexp_replace(F.url_decode(F.regexp_replace(F.substring_index(p, "=", 1), "%(?![0-9A-Fa-f]{2})", "%25")), r"\[\d+\]", "[]").alias("k"),
        F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1).alias("v")))
    return F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & (p["k"] != "page")))


def next_pages(pages: DataFrame) -> DataFrame:
    """(source, url, page_no): the following listing page each page links to, at most up to the third page."""
    c = F.col
    known = pages.filter(c("source").isin(*PAGINATED) & (c("page_no") < 3))
    links = F.transform(find_all(tag("a", href=None)), lambda n: F.struct(
        attribute(n, "href").alias("href"), attribute(n, "data-page").isNotNull().alias("numbered")))
    flat = with_page(known, "source", c("url").alias("page_url"), "page_no")
    rows = flat.select("source", c("page_url").alias("base"), "page_no", F.posexplode(links).alias("pos", "link")).select(
        "source", "base", "page_no", "pos", "link.numbered", safe_url(c("link.href"), c("base")).alias("target"))
    hosts = reduce(lambda a, b: a | b, ((c("source") == s) & url_host(c("target")).isin(*vocab.SOURCE_HOSTS[s]) for s in PAGINATED))
    same = hosts & (url_host(c("target")) == url_host(c("base")))
    following = (c("page_no") + 1).cast("string")
    by_path = (c("source") == "fl_ru") & (url_query(c("target")) == "") & (
        url_path(c("target")) == F.concat(F.regexp_replace(url_path(c("base")), r"page-\d+/\z", ""), F.lit("page-"), following, F.lit("/")))
    numbers = F.filter(F.split(url_query(c("target")), "&"), lambda p: p.startswith("page="))
    by_query = ((c("source") == "freelance_ru") & c("numbered") & (url_path(c("target")) == "/task") & (url_path(c("base")) == "/task")
                & (F.array_join(numbers, "&") == F.concat(F.lit("page="), following))
                & (_filters(url_query(c("target"))).eqNullSafe(_filters(url_query(c("base"))))))
    fits = rows.filter(c("target").isNotNull() & same & (by_path | by_query))
    return fits.groupBy("source", "base", "page_no").agg(F.min_by("target", "pos").alias("url")).select(
        "source", "url", (c("page_no") + 1).alias("page_no"))
