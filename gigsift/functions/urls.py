"""URL columns: validation, canonical form, project links, original cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from .text import full, rx

ABSOLUTE = r"\A([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
UNSAFE_CHARACTER = r"[\p{IsWhite_Space}\\\x00-\x1f\x7f]"
ENCODED_CONTROL = r"(?i)%(?:0[0-9a-f]|1[0-9a-f]|7f)"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, ABSOLUTE, group)


def without_dot_segments(path: Column) -> Column:
    """Resolve '.' and '..' in an absolute path."""
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda kept, s: F.when(s == ".", kept)
        .when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
        .otherwise(F.array_append(kept, s)))
    resolved = F.concat(F.array_join(folded, "/"), F.when(path.rlike(r"/\.{1,2}\z"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(?:\A|/)\.{1,2}(?:/|\z)"), F.when(resolved.startswith("/"), resolved).otherwise(F.concat(F.lit("/"), resolved))).otherwise(path)


def absolute(href: Column, base: Column | None) -> Column:
    """Resolve a link against the page it stands on."""
    if base is None:
        return href
    root = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"\A([^?#]*)", 1)
    folder = F.regexp_extract(base, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    href_path = F.regexp_extract(href, r"\A([^?#]*)", 1)
    href_rest = F.regexp_extract(href, r"\A[^?#]*(.*)\z", 1)
    joined = F.when(href_path.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    return (F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("?"), F.concat(page, href))
            .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"\A([^#]*)", 1), href))
            .otherwise(F.concat(root, without_dot_segments(joined), href_rest)))


def server_of(netloc: Column) -> Column:
    return F.regexp_replace(netloc, r"\A.*@", "")


def url_error(href: Column, base: Column | None = None, hosts: tuple[str, ...] | None = None, resolved: Column | None = None,
              parts: tuple[Column, Column] | None = None) -> Column:
    """Fixed error code of a link, or NULL if it is an acceptable HTTPS URL. `resolved`: a column that holds `absolute(href, base)`;
    `parts`: columns that hold its netloc and the `server_of` that."""
    url = absolute(href, base) if resolved is None else resolved
    netloc = part(url, 2)
    netloc, server = parts or (netloc, server_of(netloc))
    port = F.regexp_extract(server, r":([^:\]]*)\z", 1)
    code = (F.when(href.isNull() | (href == "") | (F.length(href) > 2048), "invalid_url")
            .when(href.rlike(UNSAFE_CHARACTER) | href.rlike(ENCODED_CONTROL), "invalid_url")
            .when(F.lower(part(url, 1)) != "https", "invalid_url")
            .when(server.rlike(r"\A(?::.*)?\z") | netloc.rlike(r"\A(?=.*@)(?!:?@)"), "invalid_url")
            .when(server.rlike(r"\[|\]") & ~server.rlike(r"\A\[[0-9A-Fa-f:.]+\](?::\d*)?\z"), "invalid_url")
            .when(~port.isin("", "443") & ~port.rlike(r"\A0+443\z"), "invalid_url"))
    if hosts is not None:
        code = F.coalesce(code, F.when(~url_host(url).isin(*hosts), "untrusted_url_host"))
    return code


def host_of(server: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(server, r":[^:\]]*\z", ""), r"[\[\]]", ""))


def url_host(url: Column) -> Column:
    return host_of(server_of(part(url, 2)))


def url_path(url: Column) -> Column:
    return part(url, 3)


def url_query(url: Column) -> Column:
    return part(url, 4)


def normal_https(url: Column) -> Column:
    """Rebuild an accepted URL: lower-case host, no port, no credentials, no fragment, at least '/'."""
    path = F.coalesce(F.nullif(url_path(url), F.lit("")), F.lit("/"))
    query = url_query(url)
    return F.concat(F.lit("https://"), url_host(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def safe_url(href: Column, base: Column | None = None, hosts: tuple[str, ...] | None = None) -> Column:
    """Normal HTTPS URL, or NULL if the link is refused (see `url_error` for the code)."""
    return F.when(url_error(href, base, hosts).isNull(), normal_https(absolute(href, base)))


def _form_decode(value: Column) -> Column:
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encode(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column) -> Column:
    """Query without tracking parameters, sorted by name and value; blank values are kept."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(_form_decode(F.substring_index(p, "=", 1)).alias("k"),
                           _form_decode(F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith(vocab.TRACKING_PREFIX)
                    & ~F.lower(p["k"]).isin(*vocab.TRACKING_KEYS))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """Identity of an accepted URL: no www., no trailing slash, known cards by id, otherwise a cleaned query."""
    host = F.regexp_replace(url_host(url), r"\Awww\.", "")
    path = F.coalesce(F.nullif(F.regexp_replace(url_path(url), r"/+\z", ""), F.lit("")), F.lit("/"))
    card = F.lit("")
    for known, pattern in vocab.CANONICAL_PATHS.items():
        card = F.when(host == known, F.regexp_extract(path, full(pattern, "U"), 1)).otherwise(card)
    query = canonical_query(url_query(url))
    root = F.concat(F.lit("https://"), host)
    return F.when(card != "", F.concat(root, card)).otherwise(
        F.concat(root, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def is_project_link(canonical: Column) -> Column:
    """Does a canonical URL point at one project or one channel post?"""
    host, path = url_host(canonical), url_path(canonical)
    result = F.lit(False)
    for known, pattern in vocab.PROJECT_LINKS.items():
        result = result | ((host == known) & path.rlike(full(pattern, "U")))
    return F.coalesce(result, F.lit(False))


def with_direct_card_url(listings: DataFrame) -> DataFrame:
    """Add `direct_url`, the URL of the original marketplace card without its query; NULL if there is none or it is somebody else's.
    Each part of the link is a column of its own, so that it is read once."""
    c = F.col
    market = c("origin_kind") == "marketplace"
    cut = listings.withColumn("_target", F.when(market, c("url")).otherwise(c("external_url"))).withColumns({
        "_netloc": part(c("_target"), 2), "_path": url_path(c("_target"))}).withColumn("_server", server_of(c("_netloc"))).withColumn(
        "_host", host_of(c("_server"))).withColumn("_site", F.regexp_replace("_host", r"\Awww\.", ""))
    card, owner = F.lit(""), F.lit(None).cast("string")
    for name, (known, pattern) in vocab.CARD_PATHS.items():  # no two share a host
        card = F.when(c("_site") == known, F.regexp_extract("_path", full(pattern, "U"), 1)).otherwise(card)
        owner = F.when(c("_site") == known, name).otherwise(owner)
    own = ~market | ((c("source") == owner) & (c("_card") == c("source_id")))
    accepted = (c("_card") != "") & own & url_error(c("_target"), parts=(c("_netloc"), c("_server"))).isNull()
    found = cut.withColumn("_card", card).withColumn("direct_url", F.when(accepted, F.concat(F.lit("https://"), c("_host"), c("_path"))))
    return found.drop("_target", "_netloc", "_path", "_server", "_host", "_site", "_card")


def fingerprint(title: Column, origin_kind: Column, url: Column, external_url: Column) -> Column:
    """SHA-256 of the normalised title and the canonical target."""
    target = F.coalesce(F.nullif(external_url, F.lit("")), F.when(origin_kind == "marketplace", url))
    return F.sha2(F.concat(title, F.lit("\n"), F.coalesce(canonical_url(target), F.lit(""))), 256)
