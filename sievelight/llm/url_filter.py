"""URL filtering: allow and block rules first, then a blocked Bloom filter with an exact join behind it.

The listed canonical URLs (any number) fill a register-blocked Bloom filter of bounded size.  It passes the
pages that may be listed to an exact hash join on the canonical URL, which removes the false positives;
all other pages are settled in the scan.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: then up to ``?``,
``#`` or the end.  Canonical: the host without one leading ``www.``, then the path without trailing slashes;
scheme, query and fragment do not count.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, is never listed,
and gets ``allow``; repeated rows are judged alike and all returned; null listed urls are skipped; other
columns are ignored; an empty list allows every page that no rule blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BlockedBloom, pick, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, rule): a rule is a host, a slash and the rest of a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+\z", "")))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits, else null.  The list of rules is configuration, so it is short."""
    found = F.lit(None).cast("int")
    for i, (_, rule) in sorted(enumerate(rules), key=lambda x: len(x[1][1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, listed)`` for every row of ``pages(page_id, url)``; ``listed(url)`` is blocked."""
    host, path = host_and_path(F.col("url"))
    rule_names = F.array(*[F.lit(r) for _, r in rules])
    actions = F.array(*[F.lit(a) for a, _ in rules])
    rows = pick(pages, page_id="long", url="string").select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"canonical": canonical(F.col("host"), F.col("path")), "at": longest_rule(F.col("host"), F.col("path"), rules)})
    keys = written(pick(listed, url="string").select(host.alias("host"), path.alias("path")).select(canonical(F.col("host"), F.col("path")).alias("canonical")).where("canonical is not null").distinct())
    bloom = BlockedBloom(keys, "canonical", keys.count())
    hits = bloom.maybe(rows, "canonical").join(keys.withColumn("listed", F.lit(True)).withColumnRenamed("canonical", "key"), F.col("canonical") == F.col("key"), "left").drop("key")
    rest = bloom.surely_not(rows, "canonical").withColumn("listed", F.lit(False))
    both = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rest)
    rule = F.when(F.col("at").isNotNull(), F.element_at(rule_names, F.col("at") + 1))
    action = F.when(F.col("at").isNotNull(), F.element_at(actions, F.col("at") + 1))
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
