"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over the URL from its host on. Its mandatory tokens are the runs of ASCII letters and digits that the pattern
bounds on both sides, so that they stand in every URL it fits as whole runs too. Each rule is filed under that of its tokens which
the fewest URLs hold. The tokens of a URL fetch candidate rules by an equi-join, and only these run their regular
expressions. Rules without a mandatory token meet every URL, slice by slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.blocks import free_name
from replyloom.runtime import materialize

#: Levels of rules: a site rule beats every pattern.
SITE, PATTERN = 2, 1
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\z)"
_RUN = re.compile("[A-Za-z0-9]+")
#: ``rule`` as it was written, ``action`` block or allow, ``regex`` over the URL from its host on, mandatory ``tokens``.
RULE_SCHEMA = "level int, rule string, action string, regex string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    level: int
    rule: str
    action: str
    regex: str
    tokens: tuple[str, ...]


def _literal(text: str) -> str:
    """Escaped for Java and RE2 alike."""
    return "".join(c if c.isalnum() or not c.isascii() else f"\\x{ord(c):02X}" for c in text)


def _mandatory(pattern: str, open_left: bool, open_right: bool) -> tuple[str, ...]:
    found = []
    for m in _RUN.finditer(pattern):
        left = pattern[m.start() - 1] != "*" if m.start() else not open_left
        right = pattern[m.end()] != "*" if m.end() < len(pattern) else not open_right
        if left and right:
            found.append(m[0])
    return tuple(dict.fromkeys(found))


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains, where the path starts with ``path``."""
    if path and not path.startswith("/"):
        raise ValueError(f"a path begins with a slash: {path!r}")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    end = _literal(path) if path else r"(?:[/?#]|\z)"
    return Rule(SITE, host + path, action, rf"(?s)^(?:[^/?#]*\.)?{_literal(host)}{end}", _mandatory(host + path, False, bool(path)))


def pattern_rule(line: str) -> Rule:
    """A line in the common notation of filter lists.

    ``||`` begins at the host or one of its labels, ``|`` at an end, ``*`` stands for anything, ``^`` for a separator or the end, ``@@``
    before the pattern makes it an exception. The rest is literal, and case counts.
    """
    body = line.removeprefix("@@")
    action = "allow" if body != line else "block"
    head, open_left = "", True
    if body.startswith("||"):
        head, body, open_left = r"^(?:[^/?#]*\.)?", body[2:], False
    elif body.startswith("|"):
        head, body, open_left = "^", body[1:], False
    open_right = not body.endswith("|")
    body = body if open_right else body[:-1]
    middle = "".join({"*": ".*", "^": SEPARATOR}.get(c) or _literal(c) for c in body)
    return Rule(PATTERN, line, action, f"(?s){head}{middle}{'' if open_right else chr(92) + 'z'}", _mandatory(body, open_left, open_right))


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.level, r.rule, r.action, r.regex, list(r.tokens)) for r in rules], RULE_SCHEMA)


def url_parts(url: Column) -> dict[str, Column]:
    """``host`` (A-Z in lower case), ``path``, and ``rest`` of the URL from the host on; '' where there is no ``://``."""
    after = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    tail = F.substring(after, F.length(host) + 1, F.length(after))
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": low, "path": F.regexp_extract(tail, "^[^?#]*", 0), "rest": F.concat(low, tail)}


def url_tokens(rest: Column) -> Column:
    return F.array_distinct(F.filter(F.split(rest, "[^A-Za-z0-9]+"), lambda t: t != ""))


def token_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` under ``token``: the mandatory token that the fewest URLs hold, '' for rules without one.

    Rules whose tokens include one that no URL holds cannot fit and are left out.
    """
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    own = rules.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    ranked = own.join(counts, "token", "left").withColumn("urls", F.when(F.col("token") == "", 0).otherwise(F.coalesce("urls", F.lit(0))))
    rule = ["level", "rule", "action", "regex"]
    rarest = ranked.groupBy(*rule).agg(F.min(F.struct("urls", "token")).alias("rarest"))
    return rarest.select(*rule, "rarest.token", "rarest.urls").where("token = '' or urls > 0")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, level, rule, action) for every rule that fits; ``urls`` has (url, rest, tokens) and holds each URL once."""
    index = materialize(token_index(urls, rules), "rule-index")
    filed = urls.select("url", "rest", F.explode("tokens").alias("token")).join(index.where("token <> ''"), "token")
    slices = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    everywhere = index.where("token = ''").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    full = urls.withColumn("slice", F.pmod(F.hash("url"), F.lit(slices))).join(everywhere, "slice")
    columns = ["url", "level", "rule", "action"]
    fits = F.expr("rlike(rest, regex)")
    return filed.where(fits).select(*columns).union(full.where(fits).select(*columns))


def judge_urls(table: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``table`` with ``host``, ``path``, ``rule``, ``pattern`` and ``verdict`` (columns of these names are replaced).

    The longest site rule that fits decides; of equally long ones the one with the longer host, and block before allow. Without one,
    an exception among the patterns that fit allows, any other pattern blocks, and ``default`` holds where none fits. ``rule``
    is the deciding site rule, ``pattern`` the deciding pattern (an exception, the longest, the last by text), else null. Null URLs and those without ``://`` have an empty host and
    path and get ``default``. Every row is kept, and repeated URLs are judged once. An empty table gives no rows.
    """
    added = ["host", "path", "rule", "pattern", "verdict"]
    kept = [c for c in table.columns if c.lower() not in added]
    own, judged, best = (free_name(table, n) for n in ("_url", "_judged", "_best"))
    whole = table.select(*kept, F.col(url).cast("string").alias(own))
    urls = whole.select(F.col(own).alias("url")).where("contains(url, '://')").distinct()
    urls = urls.withColumn("rest", url_parts(F.col("url"))["rest"]).select("url", "rest", url_tokens(F.col("rest")).alias("tokens"))
    fitting = matches(materialize(urls, "urls"), rules)
    site, blocks = F.col("level") == SITE, F.col("action") == "block"
    size, head = F.length("rule"), F.instr("rule", "/")
    order = F.struct(
        "level",
        F.when(site, size).otherwise(F.when(blocks, 0).otherwise(1)).alias("first"),
        F.when(site, head).otherwise(size).alias("second"),
        F.when(blocks, 1).otherwise(0).alias("third"), "rule", "action",
    )
    chosen = fitting.groupBy(F.col("url").alias(judged)).agg(F.max(order).alias(best))
    parts, level = url_parts(F.col(own)), F.col(f"{best}.level")
    return whole.join(chosen, F.col(own) == F.col(judged), "left").select(
        *kept, parts["host"].alias("host"), parts["path"].alias("path"),
        F.when(level == SITE, F.col(f"{best}.rule")).alias("rule"), F.when(level == PATTERN, F.col(f"{best}.rule")).alias("pattern"),
        F.coalesce(F.col(f"{best}.action"), F.lit(default)).alias("verdict"),
    )
