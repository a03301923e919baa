"""Secret scans: literal patterns, and a battery of randomness tests over long runs of token characters.

All work is done by built-in column functions. Base spans come from PATTERNS. Candidates are runs of token characters of MIN_LENGTH
and more. Their encoding is inferred from the characters they hold, and three tests are made over the symbols' places in its alphabet:

  chi-squared   do all symbols occur equally often?
  runs          do symbols of the lower and upper half take turns as in a random sequence?
  serial        is the correlation of neighbours zero?

A candidate passes the battery if Fisher's combination of the three keeps the hypothesis of randomness at the level REJECT. For the
other error there is a p-value of being as even as that by chance, if symbols repeated as often as they do in words and names (COINCIDENCE):
the statistic is then shifted in proportion to the length, so longer candidates get smaller values. Benjamini-Hochberg over the candidates
of the whole table keeps the expected share of false finds at RATE. Random spans that overlap a base span are not added.

Spans count code points, their ends are exclusive, and the base kinds come in the order of PATTERNS, `random` last.

Defined results: null texts are empty and have no spans; every row is scanned, repeated ones each; rows are told apart by nothing, so
doc_id may be null or repeat; a table without candidates has no threshold and adds no spans; other columns are not looked at. The
driver gets one number, the threshold. Recovery: texts are read once, what the rest needs is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import require, stored

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> pattern, for runs of one class with the least length in it: that drops the same matches as a later filter
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
ASSIGN_LENGTH = 12
MIN_LENGTH = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH
KINDS = (*PATTERNS, "random")
REJECT, RATE, COINCIDENCE = 0.01, 0.05, 0.065
BINS_PER_DECADE, DECADES = 100, 40
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encoding -> (test of a run, alphabet); the first that fits is taken
ENCODINGS = {
    "decimal": ("^[0-9]+$", "0123456789"),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "lower": ("^[a-z]+$", LETTERS.lower()),
    "upper": ("^[A-Z]+$", LETTERS),
    "base32": ("^[A-Z2-7]+$", LETTERS + "234567"),
    "alnum": ("^[A-Za-z0-9]+$", LETTERS + LETTERS.lower() + "0123456789"),
    "base64": ("", LETTERS + LETTERS.lower() + "0123456789+/"),
}
_OPEN, _CLOSE = "\x01", "\x02"


def _plain(text: Column) -> Column:
    """The text with the two marks taken by another control character of equal length, which no pattern knows."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "\x03\x03")


def matches(plain: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost matches that do not overlap: the text is marked, cut at the marks, and the
    lengths of the pieces are added up."""
    pieces = F.split(F.regexp_replace(plain, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), f"[{_OPEN}{_CLOSE}]")
    empty = F.expr("CAST(array() AS array<struct<start: int, end: int, match: string>>)")

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        found = F.struct(state["at"].alias("start"), end.alias("end"), piece.alias("match"))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"),
                        F.when(state["inside"], F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("found"))
    return F.when(plain.rlike(pattern), F.aggregate(pieces, start, step)["found"]).otherwise(empty)


def _two_sided(z: Column) -> Column:
    """The two-sided p-value of a standard normal value, by a logistic approximation."""
    size = F.least(F.abs(z), F.lit(12.0))
    return 2 / (1 + F.exp(1.5976 * size + 0.07056 * size * size * size))


def _upper(z: Column) -> Column:
    size = F.greatest(F.lit(-12.0), F.least(z, F.lit(12.0)))
    return 1 / (1 + F.exp(1.5976 * size + 0.07056 * size * size * size))


def battery(candidates: Column) -> Column:
    """array<struct<start, end, random, chance>> of array<struct<start, end, match>>: whether the tests keep randomness, and the
    p-value of such evenness by chance."""
    body = lambda c: F.translate(F.rtrim(c["match"], F.lit("=")), "-_", "+/")

    def encoded(c: Column) -> Column:
        alphabet = F.lit(ENCODINGS["base64"][1])
        for test, signs in reversed([v for v in ENCODINGS.values() if v[0]]):
            alphabet = F.when(c["body"].rlike(test), F.lit(signs)).otherwise(alphabet)
        return alphabet

    def places(c: Column) -> Column:
        signs = F.when(F.length(c["alphabet"]) == 16, F.lower(c["body"])).otherwise(c["body"])
        return F.transform(F.filter(F.split(signs, ""), lambda s: s != ""), lambda s: F.instr(c["alphabet"], s) - 1)

    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    pairs = lambda x, f: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), f)

    def sums(c: Column) -> Column:
        x, k = c["x"], c["k"]
        squares = total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))))
        high = total(F.transform(x, lambda v: F.when(2 * v >= k, 1.0).otherwise(0.0)))
        runs = 1 + total(pairs(x, lambda a, b: F.when((2 * a >= k) != (2 * b >= k), 1.0).otherwise(0.0)))
        mean = total(F.transform(x, lambda v: v.cast("double"))) / F.size(x)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), k.alias("k"), F.size(x).cast("double").alias("n"),
                        squares.alias("squares"), high.alias("high"), runs.alias("runs"), mean.alias("mean"), x.alias("x"))

    def tests(c: Column) -> Column:
        n, k, low, x, mean = c["n"], c["k"], c["n"] - c["high"], c["x"], c["mean"]
        spread = total(F.transform(x, lambda v: F.pow(v - mean, F.lit(2.0))))
        shared = total(pairs(x, lambda a, b: (a - mean) * (b - mean)))
        both = 2 * low * c["high"]
        variance = both * (both - n) / (n * n * (n - 1))
        chi = c["squares"] * k / n - n
        freedom = k - 1
        # Wilson-Hilferty makes the statistic normal
        even = (F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        turns = F.when(variance > 0, (c["runs"] - both / n - 1) / F.sqrt(variance)).otherwise(F.sqrt(n))
        serial = F.when(spread > 0, shared / spread * F.sqrt(n)).otherwise(F.sqrt(n))
        shift = n * k * (F.greatest(F.lit(COINCIDENCE), 1.6 / k) - 1 / k)
        chance = _upper((freedom + shift - chi) / F.sqrt(2 * freedom + 4 * shift))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), chance.alias("chance"),
                        (-(F.log(_upper(even)) + F.log(_two_sided(turns)) + F.log(_two_sided(serial)))).alias("h"))

    staged = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), body(c).alias("body")))
    staged = F.filter(staged, lambda c: F.length(c["body"]) >= 2)
    staged = F.transform(staged, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["body"].alias("body"), encoded(c).alias("alphabet")))
    staged = F.transform(staged, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"),
                                                    F.length(c["alphabet"]).cast("double").alias("k"), places(c).alias("x")))
    tested = F.transform(F.transform(staged, sums), tests)
    # Fisher's statistic 2h has six degrees of freedom under randomness
    return F.transform(tested, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"),
        (F.exp(-c["h"]) * (1 + c["h"] + c["h"] * c["h"] / 2) >= REJECT).alias("random"), c["chance"].alias("chance")))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of every row: base spans as array<struct<start, end, kind>>, and the tested candidates that overlap
    none of them. Kinds are numbered as in KINDS."""
    require(docs, "doc_id", "text")
    plain = docs.select("doc_id", _plain(F.col("text")).alias("plain"))
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = matches(F.col("plain"), pattern)
        if kind == "assign":
            spans = F.filter(spans, lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_LENGTH)
        found.append(_of_kind(spans, number))
    rows = plain.select("doc_id", F.array_sort(F.concat(*found)).alias("base"), matches(F.col("plain"), CANDIDATE).alias("runs"))
    apart = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select("doc_id", "base", battery(apart).alias("candidates"))


def chance_threshold(scanned: DataFrame, rate: float = RATE) -> float:
    """The largest p-value that Benjamini-Hochberg accepts over all candidates that pass the battery; p-values are rounded up to one of
    BINS_PER_DECADE * DECADES steps."""
    step = F.least(F.lit(BINS_PER_DECADE * DECADES), F.floor(-F.log10(F.col("c.chance")) * BINS_PER_DECADE))
    steps = (scanned.select(F.explode("candidates").alias("c")).groupBy(step.alias("step"))
             .agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("c.random")).alias("n")))
    ranked = steps.select("step", F.sum("n").over(Window.orderBy(F.desc("step"))).alias("rank"), F.sum("tested").over(
        Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    accepted = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / BINS_PER_DECADE) <= rate * F.col("rank") / F.col("m"))
    best = accepted.agg(F.min("step")).first()[0]
    return 0.0 if best is None else 10.0 ** (-best / BINS_PER_DECADE)


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of struct<start, end, kind> in order; spans holds base and added ones."""
    scanned = stored(scan(docs), "secret-candidates")
    most = chance_threshold(scanned, rate)
    chosen = F.filter("candidates", lambda c: c["random"] & (c["chance"] <= most) & F.lit(most > 0))
    added = _of_kind(chosen, KINDS.index("random"))
    # order by start, then kind
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return scanned.select("doc_id", F.array_sort("base", order).alias("base"), F.array_sort(F.concat("base", added), order).alias("spans"))


def span_text(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
