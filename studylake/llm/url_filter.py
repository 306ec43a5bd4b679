"""URL filter with DataFrame functions only: rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm.common import ascii_lower, join_spread, keep

RULES = "rule string, kind string, verdict string, weight int, pattern string, literals array<string>"

#: Pattern rules for urls that no site rule fits: name, regular expression over the lower-cased url, literal tokens that
#: each matching url holds as whole tokens.
PATTERNS = (
    ("reply form", r"[?&]replytocom=\d", ["replytocom"]),
    ("login form", r"/wp-login\.php(?:[?#]|$)", ["wp", "login", "php"]),
    ("session id", r"[?&;](?:phpsessid|jsessionid)=", []),
    ("calendar trap", r"/calendar/\d{4}/\d{1,2}/\d{1,2}", ["calendar"]),
    ("print view", r"[?&]print=(?:1|true|yes)\b", ["print"]),
    ("cart action", r"[?&]add-to-cart=\d", ["add", "to", "cart"]),
)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; '' without one or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; '' without a host part or for null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def words(text: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]


def site_rule(site: str, start: str, verdict: str) -> tuple:
    """A rule for a host with its subdomains and the paths that begin with start, over host and path joined."""
    quoted = "".join(c if c.isalnum() else f"\\{c}" for c in site), "".join(c if c.isalnum() else f"\\{c}" for c in start)
    whole = start if not start or not start[-1].isalnum() else start[: start.rfind(words(start)[-1])] if words(start) else ""
    return f"{site}{start}", "site", verdict, len(site) + len(start), r"^(?:[^/]*\.)?" + quoted[0] + (quoted[1] or "(?:/|$)"), words(site) + words(whole)


def rule_table(spark: SparkSession, sites: Iterable[tuple[str, str, str]], patterns: Iterable[tuple[str, str, list[str]]] = PATTERNS) -> DataFrame:
    """Rules as a DataFrame: sites are (host, path, verdict); patterns are (name, regular expression, literals) and block."""
    rows = [site_rule(*x) for x in sites] + [(name, "pattern", "block", 0, pattern, [t for x in literals for t in words(x)]) for name, pattern, literals in patterns]
    return spark.createDataFrame(rows, RULES)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", few: int = 10_000) -> DataFrame:
    """Returns (id, url, host, path, rule, pattern_rule, verdict) for each row of pages.

    Each distinct url is judged once, so repeated urls cost nothing. Its tokens fetch the rules indexed under them and
    only those rules' expressions run. The longest fitting site rule decides (ties to the smaller name); without one, a
    url is blocked if a pattern rule fits, else allowed. A null url has an empty host and path, and is allowed. An empty
    table gives no rows; further columns play no part.
    A url of any length is judged whole. A rule's token is the one that fewest urls hold; rules without literals are tried on all
    urls. Rules are counted: up to `few` of them are sent to all tasks, so that no token of many urls is shuffled; more are
    joined by token, and tokens of many urls are salted, as are urls of many pages when they get their verdict.
    """
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = given.where(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("pages"))
    tokens = F.array_distinct(F.split(ascii_lower(F.col("url")), "[^a-z0-9]+"))
    held = urls.select("url", F.explode(F.array_union(tokens, F.array(F.lit("")))).alias("token"))
    literals = rules.select("rule", F.explode("literals").alias("token")).distinct()
    asked = literals.select("token").union(rules.sparkSession.createDataFrame([("",)], "token string")).distinct()
    counts = keep(held.join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")), "url-tokens")
    ranked = literals.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")).alias("best"))
    index = keep(rules.join(ranked, "rule", "left").withColumn("token", F.coalesce("best.token", F.lit(""))).drop("best", "literals"), "url-rules")
    if index.count() <= few:
        found = held.join(F.broadcast(index), "token")
    else:
        names = ("rule", "kind", "verdict", "weight", "pattern")
        by_token = index.groupBy("token").agg(F.collect_list(F.struct(*names)).alias("rules")).join(counts, "token")
        found = join_spread(held, by_token, ["token"], "n", "url").select("url", F.inline("rules"))
    lower = ascii_lower(F.col("url"))
    fits = F.when(F.col("kind") == "site", F.rlike(F.concat(host(F.col("url")), path(F.col("url"))), F.col("pattern"))).otherwise(F.rlike(lower, F.col("pattern")))
    site = F.min(F.when(F.col("kind") == "site", F.struct(-F.col("weight"), "rule", "verdict")))
    other = F.min(F.when(F.col("kind") == "pattern", F.struct("rule", "verdict")))
    best = found.where(fits).groupBy("url").agg(site.alias("site"), other.alias("other"))
    judged = urls.join(best, "url", "left")
    known = join_spread(given.where(F.col("url").isNotNull()), judged.withColumnRenamed("url", "judged").withColumn("url", F.col("judged")), ["url"], "pages", "id")
    known = known.select("id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("site.rule").alias("rule"), F.col("other.rule").alias("pattern_rule"), F.coalesce("site.verdict", "other.verdict", F.lit("allow")).alias("verdict"))
    none = F.lit(None).cast("string")
    return known.unionByName(given.where(F.col("url").isNull()).select("id", "url", F.lit("").alias("host"), F.lit("").alias("path"), none.alias("rule"), none.alias("pattern_rule"), F.lit("allow").alias("verdict")))
