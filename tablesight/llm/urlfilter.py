"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens that any URL it fits must contain as whole
tokens (host labels, path segments and their parts between non-letters). The
rule is filed under the one that is rarest among the URLs at hand. A URL
fetches the rules filed under its tokens, and only those run their regular
expression. DataFrame operations only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of host and path prefix: (verdict, rule).
SITE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
              ("allow", "com/fr/"), ("block", "com/de/")]
MAX_BROADCAST_RULES = 20_000


def host_word(*parts: str) -> tuple[str, list[str]]:
    """Pattern and tokens of a rule for hosts that hold ``parts``, joined by
    hyphens, between dots, hyphens or the ends of the host."""
    return rf"^([^/]*[.-])?{'-'.join(parts)}([.-][^/]*)?(/|\z)", list(parts)


#: Blocked hosts among the URLs that no site rule fits.
PATTERN_RULES = [host_word("casino"), host_word("bets"), host_word("cheap", "pills"), host_word("porn"),
                 host_word("xxx"), host_word("viagra"), host_word("payday", "loans")]


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def listed(spark: SparkSession, rules, site: bool) -> DataFrame:
    """A short list of rules as a table: (verdict, rule), or (pattern, tokens)."""
    if isinstance(rules, DataFrame):
        return rules
    if any(not (re.search("[0-9a-z]", rule.rpartition("/")[0], re.I) if site else found) for _, rule, found in
           ([(v, r, None) for v, r in rules] if site else [(p, p, t) for p, t in rules])):
        raise ValueError("every rule needs a literal token")
    if not rules:
        return spark.range(0).selectExpr(*(["'' as verdict", "'' as rule"] if site else ["'' as pattern", "array('') as tokens"]))
    if site:
        cells = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
    else:
        cells = [F.struct(F.lit(p).alias("pattern"), F.array(*map(F.lit, t)).alias("tokens")) for p, t in rules]
    return spark.range(1).select(F.inline(F.array(*cells)))


def rule_table(spark: SparkSession, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(rule, verdict, pattern, tokens, rank); patterns are matched against
    host + path. A host has no slash and a path begins with one or is empty,
    so the two can't be confused. rank: longer site rules go first, patterns
    last.

    Rules come as short lists, or as tables of any length: site rules
    (verdict, rule), pattern rules (pattern, tokens), where each of the
    lower-cased tokens must stand in every URL that the pattern fits. A rule
    without a token raises, a list's at once and a table's when it is run.
    """
    sites = listed(spark, site_rules, True).filter("rule is not null")
    host = ascii_lower(F.substring_index("rule", "/", 1))
    tail = F.substring(F.col("rule"), F.length(host) + 1, F.length("rule"))
    fixed = F.replace(F.concat(host, tail), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    # The last segment of a rule may go on in the URL, so it gives no whole token.
    found = words_of(F.concat(host, F.regexp_extract(tail, r"^((?s).*/)", 1)))
    sites = sites.select("rule", "verdict", F.concat(F.lit(r"^([^/]*\.)?\Q"), fixed, F.lit(r"\E")).alias("pattern"),
                         found.alias("tokens"), F.length("rule").alias("rank"))
    patterns = listed(spark, pattern_rules, False).filter("pattern is not null")
    patterns = patterns.select(F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), "pattern", "tokens", F.lit(0).alias("rank"))
    none = F.coalesce(F.size("tokens"), F.lit(0)) < 1
    checked = F.when(none, F.raise_error(F.lit("every rule needs a literal token"))).otherwise(F.col("tokens"))
    return sites.unionByName(patterns).withColumn("tokens", checked)


def few(rules, most: int = MAX_BROADCAST_RULES) -> bool:
    """Whether there are at most ``most`` rules; a table is counted up to that."""
    return (rules.limit(most + 1).count() if isinstance(rules, DataFrame) else len(rules)) <= most


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: host follows the first ``://`` up to ``/``, ``?``,
    ``#`` or the end, ASCII letters lower-cased; path goes on up to ``?``,
    ``#`` or the end. Without ``://``, or null: both empty."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/]*)", 1))
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/]*((?s).*)$", 1))


def words_of(column):
    """Whole literal tokens of a host and path."""
    return F.array_distinct(F.array_remove(F.split(F.lower(column), r"[^0-9a-z]+"), ""))


def judge(pages: DataFrame, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    The longest site rule that fits decides (of equal lengths the smaller
    text, of two verdicts allow) and is named in ``rule``. Else a pattern rule that fits blocks, and
    the rest get ``default``; both leave ``rule`` null. Null or odd URLs have
    an empty host and get the default. Equal URLs get equal results. Other
    columns are ignored.

    Distinct URLs are judged, so a hot URL costs one evaluation. The rule
    index is broadcast if there are at most MAX_BROADCAST_RULES rules of each
    kind (tables are counted first) and else joined by shuffle. A page fetches each rule once at most, since a rule is
    filed under one token only.
    """
    spark = pages.sparkSession
    parts = split_url(pages.select("page_id", F.col("url").cast("string").alias("url")))
    urls = parts.filter("host <> ''").select(F.concat("host", "path").alias("site")).distinct()
    found = urls.select("site", F.explode(words_of(F.col("site"))).alias("token"))
    rules = rule_table(spark, site_rules, pattern_rules)
    hint = F.broadcast if few(site_rules) and few(pattern_rules) else (lambda df: df)
    named = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = found.join(hint(named), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (rules.select("*", F.explode("tokens").alias("token")).join(hint(seen), "token", "left")
              .groupBy("rule", "verdict", "pattern", "rank")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("key"))
              .select("rule", "verdict", "pattern", "rank", F.col("key.token").alias("token")))
    hits = found.join(hint(rarest), "token").filter(F.expr("site rlike pattern"))
    best = hits.groupBy("site").agg(F.min(F.struct((-F.col("rank")).alias("rank"), "rule", "verdict")).alias("best"))
    out = parts.withColumn("site", F.concat("host", "path")).join(best, "site", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
