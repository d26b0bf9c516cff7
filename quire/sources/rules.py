"""Source rules as typed DataFrames: load, defaults, projection, prefix match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t


def _section(numbers: str, flags: str, texts: str) -> t.StructType:
    made = [t.StructField(n, t.IntegerType()) for n in numbers.split()] + [t.StructField(n, t.BooleanType()) for n in flags.split()]
    return t.StructType(made + [t.StructField(n, t.StringType()) for n in texts.split()])


SEARCH = _section("timeout", "disabled", "baseUri url method data cookies result bookName author category latestChapter lastUpdateTime status wordCount nextPage")
BOOK = _section("timeout", "", "baseUri url bookName author intro category coverUrl latestChapter latestChapterUrl lastUpdateTime status")
TOC = _section("timeout", "isDesc", "baseUri url list item nextPage")
CHAPTER = _section("timeout", "paragraphTagClosed", "baseUri title content paragraphTag filterTxt filterTag nextPage nextPageInJs nextChapterLink")
CRAWL = _section("concurrency maxAttempts minInterval maxInterval retryMinInterval retryMaxInterval", "", "")
RULE = t.StructType(
    [t.StructField(n, t.StringType()) for n in ("url", "name", "comment", "language")]
    + [t.StructField(n, t.BooleanType()) for n in ("needProxy", "disabled")]
    + [t.StructField(n, s) for n, s in (("search", SEARCH), ("book", BOOK), ("toc", TOC), ("chapter", CHAPTER), ("crawl", CRAWL))]
)
#: Seconds that a section may take unless its rule says otherwise.
TIMEOUTS = {"search": 15, "book": 15, "toc": 60, "chapter": 15}
#: Where the fields of a book stand unless its rule says otherwise.
BOOK_DEFAULTS = {
    "bookName": 'meta[property="og:novel:book_name"]',
    "author": 'meta[property="og:novel:author"]',
    "intro": 'meta[name="description"]',
    "category": 'meta[property="og:novel:category"]',
    "coverUrl": 'meta[property="og:image"]',
    "latestChapter": 'meta[property="og:novel:latest_chapter_name"]',
    "latestChapterUrl": 'meta[property="og:novel:latest_chapter_url"]',
    "lastUpdateTime": 'meta[property="og:novel:update_time"]',
    "status": 'meta[property="og:novel:status"]',
}
LANGUAGE = "zh-CN"


def _filled(col: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), default)


def with_defaults(rules: DataFrame) -> DataFrame:
    """Rules with language, base addresses, timeouts and the expressions of a book filled in."""
    out = rules.withColumn("language", _filled(F.col("language"), F.lit(LANGUAGE)))
    for name, seconds in TIMEOUTS.items():
        section = F.col(name)
        made = section.withField("baseUri", _filled(section["baseUri"], F.col("url"))).withField("timeout", F.coalesce(section["timeout"], F.lit(seconds)))
        if name == "book":
            for key, default in BOOK_DEFAULTS.items():
                made = made.withField(key, _filled(section[key], F.lit(default)))
        out = out.withColumn(name, F.when(section.isNotNull(), made))
    return out


def _numbered(parsed: DataFrame) -> DataFrame:
    return parsed.select((F.col("pos") + 1).alias("id"), "rule.*")


def parse_rules(spark: SparkSession, text: str) -> DataFrame:
    """Rules of a JSON array, numbered from 1 in order, with defaults; one malformed element fails the whole text."""
    parsed = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", t.ArrayType(RULE), {"mode": "FAILFAST"}).alias("rules"))
    return with_defaults(_numbered(parsed.select(F.posexplode("rules").alias("pos", "rule"))))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file; raises if the file is missing or malformed."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", t.ArrayType(RULE), {"mode": "FAILFAST"}).alias("rules"))
    return with_defaults(_numbered(whole.select(F.posexplode("rules").alias("pos", "rule"))))


def replace_rules(spark: SparkSession, text: str, view: str = "rules") -> int:
    """Puts a new set of rules under a view at once; the old set stays if the new one is malformed or empty."""
    new = parse_rules(spark, text)
    n = new.count()
    if not n:
        raise ValueError("no rules")
    new.createOrReplaceTempView(view)
    return n


def source_list(rules: DataFrame) -> DataFrame:
    return rules.where(~F.coalesce("disabled", F.lit(False))).select("id", "name", "url", "comment", F.coalesce("disabled", F.lit(False)).alias("disabled"))


def match_rules(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """pages with rule_id and rule_name of the first rule (by id, disabled ones too) whose url begins the page's; null
    without one.

    Rules that name a whole host, as all usual ones do, meet pages by equal origin, so this is a hash join however many rules
    there are; only rules with less than an origin are tried against every page, and these are few.
    """
    r = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), F.col("url").alias("rule_url"))
    full = F.col("rule_url").rlike("^[^:/]+://[^/]+/")
    start = lambda p: p["url"].startswith(F.col("rule_url"))
    site = F.regexp_extract(F.col("rule_url"), "^(.*?://[^/]*)", 1)
    p = pages.withColumn("__site", F.regexp_extract(F.coalesce("url", F.lit("")), "^(.*?://[^/]*)", 1))
    by_site = r.where(full).withColumn("__site", site).groupBy("__site").agg(F.array_sort(F.collect_list(F.struct("rule_id", "rule_name", "rule_url"))).alias("__near"))
    loose = r.where(~full).agg(F.array_sort(F.collect_list(F.struct("rule_id", "rule_name", "rule_url"))).alias("__loose"))
    small = by_site.limit(100_001).count() <= 100_000
    joined = p.join(F.broadcast(by_site) if small else by_site, "__site", "left").crossJoin(F.broadcast(loose))  # one row
    fitting = F.filter(F.concat(F.coalesce("__near", F.array().cast("array<struct<rule_id:int,rule_name:string,rule_url:string>>")), "__loose"), lambda x: p["url"].startswith(x["rule_url"]))
    first = F.get(F.array_sort(fitting), F.lit(0))
    return joined.withColumn("__first", first).select(*pages.columns, F.col("__first.rule_id").alias("rule_id"), F.col("__first.rule_name").alias("rule_name"))


def source_status(rules: DataFrame, probes: DataFrame) -> DataFrame:
    """Sources with delay and code of probes (id, delay, code), -1 without; answers first, quickest first."""
    known = source_list(rules).join(probes, "id", "left")
    out = known.select("id", "name", "url", "comment", "disabled", F.coalesce("delay", F.lit(-1)).cast("long").alias("delay"), F.coalesce("code", F.lit(-1)).cast("long").alias("code"))
    return out.orderBy(F.col("delay") < 0, "delay", "id")


def crawl_settings(rules: DataFrame, defaults: dict[str, int], most: int = 100) -> DataFrame:
    """(id, settings...): a rule's own settings before the defaults; concurrency within 1 and `most`."""
    own = {k: F.coalesce(F.col("crawl")[k], F.lit(v)) for k, v in defaults.items()}
    if "concurrency" in own:
        own["concurrency"] = F.least(F.greatest(own["concurrency"], F.lit(1)), F.lit(most))
    return rules.select("id", *(c.alias(k) for k, c in own.items()))
