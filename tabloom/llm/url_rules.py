"""URL filters with pattern rules indexed by their rarest literal token.

Every rule is a regular expression on ``host + path`` with literal tokens that each match must hold as whole
tokens. Over all distinct URLs the tokens of the rules are counted, and each rule is filed under the rarest of its
tokens. A URL's tokens fetch their rules, and only those run their expressions. Rules without literals are filed
under a token that every URL has, so that none is lost.

Of the rules that fit, the highest tier wins, then the longest text, then the first text in order. Without a rule
the verdict is to allow.

Defined cases: a null URL, or one without ``://``, has an empty host and path; an unknown token fetches nothing;
repeated rows get the same verdict each; without rules everything is allowed; an empty table gives an empty table;
other columns pass through, columns called like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.llm.common import ascii_lower

RESULTS = ("host", "path", "rule", "verdict")
#: Filed rules up to this number are sent to all tasks; more are joined by shuffle.
BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    tier: int = 1


def host_path_rule(text: str, action: str, tier: int = 2) -> Rule:
    """Fits the host and its subdomains where the path starts with the rule's, as in ``example.com/en/``."""
    host, slash, path = text.partition("/")
    path = slash + path
    whole = path if re.search(r"[^0-9A-Za-z]$", path) else re.sub(r"[0-9A-Za-z]+$", "", path)
    tokens = re.findall(r"[0-9a-z]+", host.lower()) + re.findall(r"[0-9a-z]+", whole.lower())
    pattern = rf"^(?:[^/]*\.)?{_quoted(host.lower())}{_quoted(path)}"
    return Rule(text, action, pattern, tuple(dict.fromkeys(tokens)), tier)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/_-])", r"\\\1", text)


def host_word_rule(word: str, action: str = "block", tier: int = 1) -> Rule:
    """Fits hosts with a label, or a part of one between hyphens, equal to the word (or words)."""
    return Rule(f"*{word}*", action, rf"^(?:[^/]*[.-])?{_quoted(word)}(?:[.:-][^/]*)?(?:/|$)", tuple(re.findall(r"[0-9a-z]+", word)), tier)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(whole, F.lit("://")), F.regexp_extract(whole, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def filed(spark: SparkSession, rules: list[Rule], urls: DataFrame) -> DataFrame:
    """One row per rule with the token it is filed under. ``urls`` has ``tokens``."""
    rows = [(r.text, r.action, r.pattern, list(r.literals) or [""], r.tier) for r in rules]
    table = spark.createDataFrame(rows, "rule string, action string, pattern string, literals array<string>, tier int")
    table = table.withColumn("token", F.explode("literals")).drop("literals")
    wanted = table.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted) if len(rows) <= BROADCAST_RULES else wanted, "token")
    counts = counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("rule", "action", "pattern", "tier").orderBy(F.coalesce("n", F.lit(0)), "token")
    return table.join(counts, "token", "left").withColumn("at", F.row_number().over(rarest)).filter("at = 1").drop("at", "n")


def judged(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (the winner's text or null) and verdict."""
    spark = df.sparkSession
    urls = df.select(F.col(url).alias("url_")).distinct()
    host, path = parts(F.col("url_"))
    urls = urls.select("url_", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    tokens = F.array_union(F.split(F.lower(target), "[^0-9a-z]+"), F.array(F.lit("")))
    urls = urls.withColumns({"target": target, "tokens": tokens})
    index = filed(spark, rules, urls)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    fetched = urls.select("url_", "target", F.explode("tokens").alias("token")).join(index, "token")
    fits = fetched.filter(F.rlike("target", F.col("pattern")))
    order = F.struct("tier", F.length("rule").alias("size"))
    won = fits.groupBy("url_").agg(F.max(F.struct(order.alias("o"), F.struct("rule", "action", "tier").alias("r"))).alias("w"))
    won = won.select("url_", "w.r.rule", F.col("w.r.action").alias("verdict"), F.col("w.r.tier").alias("rule_tier"))
    plain = df.drop(*RESULTS, "rule_tier") if url not in RESULTS else df
    joined = plain.join(won, plain[url] == won["url_"], "left")
    host, path = parts(plain[url])
    return joined.select(
        *[plain[c] for c in plain.columns], host.alias("host"), path.alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), "rule_tier",
    )
