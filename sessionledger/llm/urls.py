"""URL verdicts from pattern rules indexed by their rarest literal token.

All work is column expressions and joins. A rule is stored under the one
of its literal tokens that the fewest distinct URLs hold; a URL looks up only
its own tokens and runs only the regular expressions it finds there.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PLACE_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: ``^`` is an end or a character that is no ASCII letter or digit, ``*`` any run.
PATTERNS = [
    "^casino-",
    "^cheap-pills^",
    "^free-bets^",
    "^adult-",
    "^ads-track^",
    "^spam-farm^",
    "^porn^",
    "/ads/*/click^",
    "^wp-login.php^",
    "?*affiliate=",
]


class Rule(NamedTuple):
    name: str  # text of a place rule, NULL for patterns
    action: str
    regex: str
    on_place: bool  # runs on host and path, else on the whole URL, A-Z lowered
    rank: int  # the highest matching rank wins
    tokens: list[str]  # whole ASCII tokens that any match contains


def place_rule(action: str, text: str) -> Rule:
    """Host and its subdomains, then a path prefix; the longer text wins."""
    host, slash, path = text.partition("/")
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # The last run of an open end may go on in the URL, so it is no token.
    tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", text.lower())
    return Rule(text, action, regex, True, 1 + len(text), tokens)


def pattern_rule(pattern: str, action: str = "block") -> Rule:
    pattern = pattern.lower()
    parts = {"^": "(?:^|[^a-z0-9]|$)", "*": "(?s:.*)"}
    regex = "".join(parts.get(c) or re.escape(c) for c in pattern)
    tokens = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern)
    return Rule(None, action, regex, False, 0, tokens)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for NULL or where there is no ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row of ``pages``: key, host, path, rule, verdict.

    A URL without a matching rule is allowed, so are NULL, the empty string
    and text that is no URL unless a pattern matches it. Each row is judged on
    its own; repeated rows stay repeated. Only ``key`` and ``url`` are read,
    so other columns may have any name.
    """
    spark = pages.sparkSession
    known = spark.createDataFrame(
        [(*r[:5], r.tokens or [""]) for r in rules],
        "rule string, action string, regex string, on_place boolean, rank int, tokens array<string>",
    )
    seen = pages.select(F.col(url).alias("url"))
    host, path = split_url(F.col("url"))
    urls = seen.distinct().filter("url is not null").select(
        "url", F.concat(host, path).alias("place"), F.translate("url", UPPER, LOWER).alias("low")
    )
    # Every URL also holds the empty token, under which rules without any are.
    tokens = urls.withColumn(
        "token", F.explode(F.array_distinct(F.concat(F.split("low", "[^a-z0-9]+"), F.array(F.lit("")))))
    )
    wanted = known.select(F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (
        known.withColumn("token", F.explode("tokens"))
        .join(counts, "token", "left")
        .groupBy("rule", "action", "regex", "on_place", "rank")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    found = (
        tokens.join(index, "token")
        .filter(F.regexp_like(F.when(F.col("on_place"), F.col("place")).otherwise(F.col("low")), F.col("regex")))
        .groupBy("url")
        .agg(F.max_by(F.struct("rule", "action"), F.struct("rank", "action")).alias("hit"))
    )
    host, path = split_url(F.col("url"))
    return (
        pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
        .join(found, "url", "left")
        .select(
            F.col("key").alias(key),
            host.alias("host"),
            path.alias("path"),
            F.col("hit.rule").alias("rule"),
            F.coalesce("hit.action", F.lit("allow")).alias("verdict"),
        )
    )


def oracle(rules: list[Rule]) -> str:
    """The verdicts with every regular expression run on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(rules, key=lambda r: -r.rank)
    hit = lambda r: f"regexp_matches({'host || path' if r.on_place else 'low'}, {quote(r.regex)})"
    case = lambda pick: "".join(f" when {hit(r)} then {pick(r)}" for r in ordered)
    return f"""
with a as (
  select page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') as low,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
b as (
  select page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from a)
select page_id, host, path,
  case{case(lambda r: quote(r.name) if r.name else "null")} end as rule,
  case{case(lambda r: quote(r.action))} else 'allow' end as verdict
from b"""
