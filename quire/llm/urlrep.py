"""URL filter: path rules first, then the empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted by host. A beta-binomial prior runs down from all pages to the
suffix, the registered domain and the host: at each level the counts are shrunk towards the mean of the level above,
with a strength fitted to the spread between the units of the level (method of moments). A page without a rule is
blocked when the upper posterior bound of its host's rate of good pages lies below a threshold.

Everything is DataFrame code. Hosts are pre-aggregated before any shuffle; the reputation table is broadcast only when it
was counted to be small, and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, lower_ascii, staged, table

#: Fixed values: (verdict, host, path) of the rules of the query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_RULES = 1000
SD_OF_BOUND = 1.0
LEAST_GOOD = 0.5


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def domain(host: Column) -> Column:
    """The last two labels; without a list of public suffixes that counts as the registered domain."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, ties to the smaller text; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"rules are compiled into one expression; give at most {MAX_RULES}")
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _shrunk(units: DataFrame, by: list[str], up: str) -> DataFrame:
    """units (n, good and the mean `up` of the level above) with the posterior a and b.

    Strength: with S = sum((good - n up)^2) / sum(n up (1 - up)), the intra-unit correlation is
    (S - 1) / (sum(n^2 up (1 - up)) / sum(n up (1 - up)) - 1), held within 0.001 and 0.999; strength = 1 / it - 1.
    """
    v = F.col(up) * (1 - F.col(up))
    fit = units.agg(
        F.sum((F.col("good") - F.col("n") * F.col(up)) ** 2).alias("s"),
        F.sum(F.col("n") * v).alias("v1"),
        F.sum(F.col("n") * F.col("n") * v).alias("v2"),
    )
    spread = F.try_divide(F.try_divide(F.col("s"), F.col("v1")) - 1, F.try_divide(F.col("v2"), F.col("v1")) - 1)
    fit = fit.select(F.round(1 / F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce(spread, F.lit(0.5)))) - 1, 6).alias("strength"))
    return (
        units.crossJoin(F.broadcast(fit))  # one row
        .withColumn("a", F.col("good") + F.col("strength") * F.col(up))
        .withColumn("b", F.col("n") - F.col("good") + F.col("strength") * (1 - F.col(up)))
        .select(*by, "n", "good", "a", "b", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
    )


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, good, a, b, mean) for every host of `outcomes` (host, good: 1, 0 or null for pages without a label)."""
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))
        .select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "good")
    )
    # each level is read several times
    hosts = staged(hosts, "hosts")
    add = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = staged(hosts.groupBy("domain", "suffix").agg(*add), "domains")
    suffixes = staged(domains.groupBy("suffix").agg(*add), "suffixes")
    whole = suffixes.agg(*add).select(((F.coalesce("good", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("up"))
    suffixes = staged(_shrunk(suffixes.crossJoin(F.broadcast(whole)), ["suffix"], "up").select("suffix", F.col("mean").alias("up")), "of-suffix")
    domains = staged(_shrunk(domains.join(suffixes, "suffix"), ["domain"], "up").select("domain", F.col("mean").alias("up")), "of-domain")
    return _shrunk(hosts.join(domains, "domain"), ["host"], "up")


def judge_urls(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None, sds: float = SD_OF_BOUND, least: float = LEAST_GOOD) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, n_labelled.

    outcomes: (host, good) of labelled pages; if none are given, the pages that a rule judges count as labelled.
    Null url or none with "://": host and path are empty, and the verdict comes from the reputation of the empty host.
    Without any label every host keeps the flat prior and is allowed. Repeated rows are judged each; other columns are
    ignored. An empty table gives an empty result.
    """
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", text).withColumn("by_rule", verdict)
    if outcomes is None:
        outcomes = ruled.select("host", (F.col("by_rule") == "allow").cast("long").alias("good"))
    else:
        outcomes = outcomes.select("host", F.col("good").cast("long").alias("good")).unionByName(ruled.select("host", F.lit(None).cast("long").alias("good")))
    a, b = F.col("a"), F.col("b")
    upper = F.col("mean") + sds * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    known = host_reputation(outcomes).select("host", F.col("n").alias("n_labelled"), F.when(upper < least, "block").otherwise("allow").alias("by_host"))
    return join_counted(ruled, known, ["host"], "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host").alias("verdict"), "n_labelled")


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _level(name: str, source: str, key: str, out: str) -> str:
    return f"""{name}_f AS (
  SELECT coalesce(greatest(0.001, least(0.999, CASE WHEN v1 > 0 AND v2 / v1 <> 1 THEN (s / v1 - 1) / (v2 / v1 - 1) ELSE 0.5 END)), 0.5) rho FROM (
    SELECT sum((good - n * up) * (good - n * up)) s, sum(n * (up * (1 - up))) v1, sum(n * n * (up * (1 - up))) v2 FROM {source})),
{name} AS (
  SELECT *, a / (a + b) {out} FROM (
    SELECT u.*, good + k * up a, n - good + k * (1 - up) b FROM {source} u, (SELECT round(1 / rho - 1, 6) k FROM {name}_f)))"""


_CASES = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _CASES]
OP8_SQL = f"""
WITH split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path FROM pages),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {f} THEN '{t}'" for f, t, _ in _FITS)} END rule,
         CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, _, v in _FITS)} END by_rule FROM split),
hosts AS (
  SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') domain_, regexp_extract(host, '[^.]*$') suffix_,
         count(by_rule) n, coalesce(sum((by_rule = 'allow')::INT), 0)::BIGINT good FROM ruled GROUP BY ALL),
domains AS (SELECT domain_, suffix_, sum(n)::BIGINT n, sum(good)::BIGINT good FROM hosts GROUP BY ALL),
suf0 AS (SELECT suffix_, sum(n)::BIGINT n, sum(good)::BIGINT good, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM hosts) up FROM domains GROUP BY ALL),
{_level("suf1", "suf0", "suffix_", "mean")},
dom0 AS (SELECT d.*, s.mean up FROM domains d JOIN suf1 s USING (suffix_)),
{_level("dom1", "dom0", "domain_", "mean")},
host0 AS (SELECT h.*, d.mean up FROM hosts h JOIN dom1 d USING (domain_)),
{_level("host1", "host0", "host", "mean")}
SELECT page_id, r.host, path, rule,
       coalesce(by_rule, CASE WHEN mean + {SD_OF_BOUND} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {LEAST_GOOD} THEN 'block' ELSE 'allow' END) verdict,
       n n_labelled
FROM ruled r JOIN host1 h USING (host)
"""
