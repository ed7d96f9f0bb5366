"""URL filter: rules are indexed by their rarest literal token.

A url's tokens (host labels and whole path segments) fetch the rules that are filed under them, and
only those rules' regular expressions run on the url.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.util import ascii_lower, free_name

#: Up to so many rules the index is a map literal in the plan (no shuffle); beyond, a join on the token.
MAP_RULES = 256
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def rule_regex(rule: str) -> str:
    """Matches host followed by path where the rule fits the host or a domain above it, and the path starts so."""
    host, path = rule_parts(rule)
    return r"(?s)^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)


def rule_tokens(rule: str) -> list[str]:
    """Tokens every fitting url has: the host's labels, and path segments that the rule closes with a slash."""
    host, path = rule_parts(rule)
    return sorted({"h:" + x for x in host.split(".") if x} | {"p:" + x for x in path.split("/")[1:-1] if x})


def url_tokens(host: Column, path: Column) -> Column:
    tokens = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(tokens("h:", F.split(host, r"\.")), tokens("p:", F.split(path, "/"))))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many urls have each of the rules' tokens; at most one row per token comes back."""
    found = urls.select(F.explode(F.array_intersect(url_tokens(F.col("host"), F.col("path")), F.array(*map(F.lit, tokens)))).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow", map_rules: int = MAP_RULES) -> DataFrame:
    """All columns of pages and host, path, rule, verdict (these replace columns of the same names).

    rules: (host/path, verdict); the longest that fits wins, among equals the first in the list. A null url, or
    one without ``://``, has empty host and path, so no rule fits: rule is null and the verdict is the default.
    Repeated rows each keep their verdict; an empty table gives an empty result.
    """
    rules = list(dict(reversed(rules)).items())[::-1]
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(pages[url]), "path": path_of(pages[url])})
    if not rules:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    every = sorted({t for rule, _ in rules for t in rule_tokens(rule)})
    counts = token_counts(parsed.select("host", "path"), every) if every else {}
    filed: dict[str, list[int]] = {}
    for k, (rule, _) in enumerate(rules):
        token = min(rule_tokens(rule), key=lambda t: (counts.get(t, 0), t), default="")
        filed.setdefault(token, []).append(k)
    if len(rules) <= map_rules:
        return _by_map(parsed, rules, filed, default)
    return _by_join(parsed, rules, filed, default)


def _rule_struct(rules: list[tuple[str, str]], k: int) -> Column:
    rule, verdict = rules[k]
    return F.struct(F.lit(len(rule)).alias("size"), F.lit(-k).alias("first"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rule_regex(rule)).alias("regex"))


def _by_map(parsed: DataFrame, rules: list, filed: dict, default: str) -> DataFrame:
    index = F.create_map(*[x for token, ks in sorted(filed.items()) for x in (F.lit(token), F.array(*[_rule_struct(rules, k) for k in ks]))])
    none = F.filter(F.array(_rule_struct(rules, 0)), lambda r: F.lit(False))
    tokens = F.concat(url_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))
    fetched = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(index, t), none)))
    fits = F.filter(fetched, lambda r: F.regexp_like(F.concat("host", "path"), r["regex"]))
    best = F.array_max(fits)
    found = free_name(parsed, "rule_found")
    return parsed.withColumn(found, best).withColumns({"rule": F.col(f"{found}.rule"), "verdict": F.coalesce(F.col(f"{found}.verdict"), F.lit(default))}).drop(found)


def _by_join(parsed: DataFrame, rules: list, filed: dict, default: str) -> DataFrame:
    spark = parsed.sparkSession
    rows = [(token, len(rules[k][0]), -k, rules[k][0], rules[k][1], rule_regex(rules[k][0])) for token, ks in filed.items() for k in ks]
    index = spark.createDataFrame(rows, "token string, size int, first int, rule string, verdict string, regex string")
    found = free_name(parsed, "rule_found")
    urls = parsed.select("host", "path").distinct()
    tokens = urls.select("host", "path", F.explode(F.concat(url_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))).alias("token"))
    fits = tokens.join(index, "token").filter(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("size", "first", "rule", "verdict")).alias(found))
    joined = parsed.join(best, ["host", "path"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in parsed.columns], F.col(f"{found}.rule").alias("rule"), F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias("verdict"))
