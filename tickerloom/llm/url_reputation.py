"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host, in DataFrame operations only.

Labelled outcomes (1: bad page) are counted per host; domains and suffixes sum their hosts' counts. Every level's rate is
shrunk towards its parent's through a beta-binomial prior whose concentration is fitted by moments over that level:
all pages -> suffix -> registered domain -> host. A host's posterior is Beta(k + s mu, n - k + s (1 - mu)); its lower bound
is taken on the log-odds scale, where a beta distribution is near to normal even for few pages: digamma and trigamma
functions give mean and variance there, Z the bound. A host is blocked where the bound's odds exceed BLOCK_ODDS times
those of the mean rate of all pages, so that clearly worse hosts are blocked whatever the base rate is.

Only urls are shuffled with pages' identifiers, page bodies are not read. A host with a third of all pages is
aggregated before its exchange, and the join that brings its verdict back is one that adaptive execution splits.

A null url, or one without "://", has empty host and path and is judged as the host "". Null labels are ignored; pages
without an outcome do not count. Without outcomes every host has the prior rate and none is blocked. Repeated pages
are judged once each, their outcomes count once each. An empty table gives an empty result. Columns of pages other
than page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import lower_ascii, written

#: verdict, host, path: a rule fits its host and all subdomains where the path starts with its path; the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labels under which registrations are made one level deeper when a two-letter country code follows.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Bounds on a prior's concentration, in pseudo-pages.
LEAST, MOST = 1.0, 1000.0
Z = 1.645
#: How many times the odds of all pages' rate a host's lower bound must have.
BLOCK_ODDS = 1.25

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """host and path of a url; both empty for null and where "://" is missing."""
    there = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(there, _PARTS, 1)), F.regexp_extract(there, _PARTS, 2)


def registered_domain(host: Column) -> Column:
    """The last two labels, three where the last two form a public suffix; a bare address as it is."""
    bare = F.regexp_replace(host, r":\d*$", "")
    deep = rf"([^.]+\.(?:{'|'.join(SECOND_LEVELS)})\.[a-z]{{2}})$"
    found = F.coalesce(F.nullif(F.regexp_extract(bare, deep, 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1), F.lit("")), bare)
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).otherwise(found)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+$|^\["), domain).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    cases = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest]
    return F.coalesce(*cases)


def _digamma(x: str) -> str:
    """SQL for the digamma function: four steps of its recurrence, then its asymptotic series (error below 1e-7)."""
    y = f"({x} + 4)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) - 1 / {x} - 1 / ({x} + 1) - 1 / ({x} + 2) - 1 / ({x} + 3))"


def _trigamma(x: str) -> str:
    y = f"({x} + 4)"
    shifts = " + ".join(f"1 / pow({x} + {i}, 2)" for i in range(4))
    return f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)) + {shifts})"


#: SQL, for Spark and DuckDB alike, over n, k, s and mu of a host: its mean, and its lower bound.
_MEAN = "(k + s * mu) / (n + s)"
_A, _B = "(k + s * mu)", "(n - k + s * (1 - mu))"
_BOUND = f"1 / (1 + exp(-({_digamma(_A)} - {_digamma(_B)} - {Z} * sqrt({_trigamma(_A)} + {_trigamma(_B)}))))"


def _concentration(level: DataFrame, name: str) -> DataFrame:
    """One row: the prior's concentration of a level with columns n, k and parent mean mu."""
    noise = F.col("mu") * (1 - F.col("mu"))
    excess = F.sum((F.col("k") - F.col("n") * F.col("mu")) * (F.col("k") - F.col("n") * F.col("mu")) - F.col("n") * noise)
    rho = F.greatest(F.coalesce(F.try_divide(excess, F.sum(F.col("n") * (F.col("n") - 1) * noise)), F.lit(0.0)), F.lit(1e-9))
    return level.agg(rho.alias("rho")).select(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), (1 - F.col("rho")) / F.col("rho"))).alias(name))


def host_reputation(judged: DataFrame) -> DataFrame:
    """Of rows (host, bad: 1, 0 or null): host, n, k, mean, bound and base (the mean rate of all pages).

    Hosts, domains and suffixes are written once each, as every level is read for its prior and for its shrinkage. The
    one-row tables of totals and concentrations are broadcast: their size is one row whatever the input.
    """
    hosts = judged.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    hosts = written(hosts, "url-hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "url-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("mu"))
    total = written(total, "url-total")

    def shrunk(level: DataFrame, by: str) -> DataFrame:
        level = written(level, f"url-{by}-priors")
        return level.join(F.broadcast(_concentration(level, "s"))).select(by, F.expr(_MEAN).alias("mu"))

    above = shrunk(suffixes.join(F.broadcast(total)), "suffix")
    above = shrunk(domains.join(above, "suffix").select("domain", "n", "k", "mu"), "domain")
    level = written(hosts.join(above, "domain").select("host", "n", "k", "mu"), "url-host-priors")
    level = level.join(F.broadcast(_concentration(level, "s"))).join(F.broadcast(total.withColumnRenamed("mu", "base")))
    return level.select("host", "n", "k", F.expr(_MEAN).alias("mean"), F.expr(_BOUND).alias("bound"), "base")


def _worse(bound: str, base: str, odds: float) -> str:
    return f"{bound} * (1 - {base}) > {odds} * {base} * (1 - {bound})"


def judged_pages(pages: DataFrame, outcomes: DataFrame, block_odds: float = BLOCK_ODDS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; with them its host's n, k, mean and bound, and the base rate.

    outcomes: key and bad, one row per key; a page's key is the number at the start of its path's second part.
    """
    host, path = url_parts(F.col("url"))
    key = F.regexp_extract(F.col("path"), r"^/[^/]*/(\d{1,18})", 1).try_cast("bigint")
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("page_key", key)
    marked = rows.join(outcomes.select(F.col("key").alias("page_key"), "bad"), "page_key", "left")
    known = host_reputation(marked.select("host", "bad"))
    fit = matched_rule(F.col("host"), F.col("path"))
    method = F.when(F.expr(_worse("bound", "base", block_odds)), F.lit("block")).otherwise(F.lit("allow"))
    joined = rows.join(known, "host").withColumn("fit", fit)
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "n", "k", "mean", "bound", "base")


def quality_outcomes(labels: DataFrame) -> DataFrame:
    """key and bad (1: labelled low quality) from the labels of the documents that pages show."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col("doc_id").alias("key")).agg((1 - F.max("quality")).cast("int").alias("bad"))


def _oracle() -> str:
    deep = rf"([^.]+\.(?:{'|'.join(SECOND_LEVELS)})\.[a-z]{{2}})$"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in longest)
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)

    def concentration(level: str, name: str) -> str:
        return f"""{name} AS (SELECT greatest({LEAST}::DOUBLE, least({MOST}::DOUBLE, (1 - rho) / rho)) AS s FROM (
  SELECT greatest(coalesce(sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0), 0), 1e-9::DOUBLE) AS rho FROM {level}))"""

    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path FROM pages),
o AS (SELECT doc_id, 1 - max(quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
m AS (SELECT host, bad FROM p LEFT JOIN o ON try_cast(regexp_extract(path, '^/[^/]*/(\d{{1,18}})', 1) AS BIGINT) = o.doc_id),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, regexp_replace(host, ':\d*$', '') AS bare FROM m GROUP BY host),
h1 AS (SELECT host, n, k, CASE WHEN regexp_matches(bare, '^[0-9.]+$|^\[') THEN bare ELSE coalesce(nullif(regexp_extract(bare, '{deep}', 1), ''), nullif(regexp_extract(bare, '([^.]+\.[^.]+)$', 1), ''), bare) END AS domain FROM h0),
h AS (SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]+$|^\[') THEN domain ELSE regexp_replace(domain, '^[^.]*\.', '') END AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
x1 AS (SELECT x.*, t.mu FROM x, (SELECT (sum(k) + 1) / (sum(n) + 2) AS mu FROM x) t),
{concentration("x1", "xs")},
d1 AS (SELECT d.*, (x1.k + s * x1.mu) / (x1.n + s) AS mu FROM d JOIN x1 USING (suffix), xs),
{concentration("d1", "ds")},
h2 AS (SELECT h.host, h.n, h.k, (d1.k + s * d1.mu) / (d1.n + s) AS mu FROM h JOIN d1 USING (domain), ds),
{concentration("h2", "hs")},
b AS (SELECT host, n, k, {_MEAN} AS mean, {_BOUND} AS bound, base FROM h2, hs, (SELECT (sum(k) + 1) / (sum(n) + 2) AS base FROM x) t),
r AS (SELECT page_id, host, path, CASE {cases} END AS rule, n, k, mean, bound, base FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN {_worse("bound", "base", BLOCK_ODDS)} THEN 'block' ELSE 'allow' END END AS verdict,
  n::BIGINT AS n, k::BIGINT AS k, round(mean, 8) AS mean, round(bound, 8) AS bound FROM r
"""


ORACLE = _oracle()
