"""URL filters (operator 4): pattern rules found by the rarest word they cannot match without.

A rule is a regular expression over ``host + path`` with the literal words (runs of a-z and 0-9)
that every address it fits must hold. Words are counted over all addresses, each rule is filed under
its rarest word, and the words of an address fetch the few rules worth running.

Two kinds of rules: host rules (a host with its subdomains, a path prefix; the longest that fits
wins) and patterns, whose verdict holds where no host rule fits; a blocking pattern wins.

Defined cases: a null address, or one without ``://``, has an empty host and path, fits no rule and
is allowed; a very long address is judged whole; rows are judged one by one, so equal rows and ids
get equal verdicts; an empty table gives an empty result; no rules allow everything. Of host rules
of one length the one with the longer host wins. Only the two named columns are read.

The rule list is a value of the program, so it fits the driver; up to ``BROADCAST_RULES`` rules the
index is broadcast, more are joined by their word through a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .common import ascii_lower, rows_of

BROADCAST_RULES = 50_000
WORD = "[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for a host with its subdomains and the paths that start with ``path``."""
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"^([^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def words(self) -> list[str]:
        # The last word of the path may go on in an address unless a mark closes it.
        whole = re.findall(WORD, self.host) + re.findall(WORD + "(?=[^a-z0-9])", self.path)
        return sorted(set(whole)) or [""]


@dataclass(frozen=True)
class Pattern:
    """Text with ``*`` for any characters, between marks or ends of ``host + path``."""
    verdict: str
    text: str

    @property
    def name(self) -> str:
        return self.text

    @property
    def regex(self) -> str:
        inner = ".*".join(re.escape(part) for part in self.text.split("*"))
        return f"(?<![a-z0-9]){inner}(?![a-z0-9])"

    @property
    def words(self) -> list[str]:
        return sorted({w.group(0) for w in re.finditer(WORD, self.text)
                       if "*" not in (self.text[w.start() - 1:w.start()], self.text[w.end():w.end() + 1])}) or [""]


# The rules of the contract.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

# Names that sites of advertisers, gamblers, sellers and adult content carry.
PATTERNS = tuple(Pattern("block", text) for text in (
    "ads-track", "adult-x", "adult", "affiliate", "bet-now", "betting", "casino", "casino-win", "cheap-pills",
    "clickbait", "free-bets", "free*coupons", "jackpot", "online*pharmacy", "payday-loans", "poker", "porn",
    "replica-watches", "slots", "spam", "spam-farm", "viagra", "xxx"))


def with_address(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``host`` (A-Z lower-cased) and ``path`` of its address."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://([^#?]*)", 1)
    host = F.substring_index(rest, "/", 1)
    return df.withColumns({"host": ascii_lower(host),
                           "path": F.substr(rest, F.char_length(host) + 1)})


def _words(subject: Column) -> Column:
    """The distinct words of an address, and the empty word, under which wordless rules are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(ascii_lower(subject), F.lit(WORD), 0)))


def rule_index(addresses: DataFrame, rules: list) -> DataFrame:
    """(word, rank, rule, verdict, host_rule, regex): every rule under its rarest word in the corpus.

    Only words of rules are counted, so the counts are as small as the rule list.
    """
    spark = addresses.sparkSession
    hosts_first = sorted(rules, key=lambda r: (isinstance(r, HostRule), len(r.name) if isinstance(r, HostRule) else 0,
                                               len(getattr(r, "host", "")), r.verdict == "block"))
    listed = rows_of(spark, {"word": "string", "rank": "bigint", "rule": "string", "verdict": "string",
                             "host_rule": "boolean", "regex": "string"},
                     [(w, rank, r.name, r.verdict, isinstance(r, HostRule), r.regex)
                      for rank, r in enumerate(hosts_first, 1) for w in r.words])
    wanted = listed.select(F.col("word").alias("_wanted")).distinct()
    wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
    seen = (addresses.select(F.explode(_words(F.concat("host", "path"))).alias("word"))
            .join(wanted, F.col("word") == F.col("_wanted"), "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("_seen")))
    counted = listed.join(seen, "word", "left").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    rarest = counted.groupBy("rank").agg(F.min(F.struct("_seen", "word")).alias("_rarest"))
    return listed.join(rarest, "rank").filter(F.col("word") == F.col("_rarest.word")).select(
        "word", "rank", "rule", "verdict", "host_rule", "regex")


def judge(df: DataFrame, key: str, url: str, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """One row per row of ``df``: key, host, path, ``rule`` (the host rule, or null), ``verdict``, and
    ``pattern`` (a pattern that fits, or null)."""
    rules = [*host_rules, *patterns]
    spark = df.sparkSession
    addresses = stored(with_address(df.select(F.col(key).alias("_key"), F.col(url).alias("_url")), "_url")
                       .select("_key", "host", "path").withColumn("_row", F.monotonically_increasing_id()), "addresses")
    index = stored(rule_index(addresses, rules), "rule-index")
    small = len(rules) <= BROADCAST_RULES
    bounded = F.broadcast if small else (lambda table: table)
    subject = F.concat("host", "path")
    words = addresses.select("_row", subject.alias("_subject"), F.explode(_words(subject)).alias("word"))
    fits = words.join(bounded(index), "word").filter(
        F.when(F.col("host_rule"), F.rlike("_subject", F.col("regex")))
        .otherwise(F.rlike(ascii_lower(F.col("_subject")), F.col("regex"))))
    best = fits.groupBy("_row").agg(F.max(F.when(F.col("host_rule"), F.col("rank"))).alias("_host_rank"),
                                    F.max(F.when(~F.col("host_rule"), F.col("rank"))).alias("_pattern_rank"))
    names = bounded(index.select("rank", "rule", "verdict").distinct())
    judged = (addresses.join(best, "_row", "left")
              .join(names.toDF("_host_rank", "rule", "_rule_verdict"), "_host_rank", "left")
              .join(names.toDF("_pattern_rank", "pattern", "_pattern_verdict"), "_pattern_rank", "left"))
    return judged.select(F.col("_key").alias(key), "host", "path", "rule",
                         F.coalesce("_rule_verdict", "_pattern_verdict", F.lit("allow")).alias("verdict"), "pattern")
