"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule (host, path prefix) becomes a prefix of canonical keys: the labels of
the host reversed, a slash, the path. ``example.com/en/`` is
``com.example//en/`` and covers the interval of all keys that begin so.
Intervals of prefixes nest or are disjoint. A url is looked up with one key for
each of its host's suffixes, so rules of parent domains are found too. Opening
and closing ends of the rules and all keys are sorted together and swept:
openings push a rule on a stack, closings pop it, and the top of the stack is
the longest rule at a key. The stack is a running depth and, for each depth,
the last rule opened there. Every sorted range is swept by its own task, which
starts from the stack that earlier ranges leave.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidence.llm.common import slots

END = b"\xff"  # sorts behind every continuation of a UTF-8 key
ORDER = ["_key", "_turn", "_salt"]


def _low(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return _low(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "UTF-8")


def _rule_ends(rules: DataFrame) -> DataFrame:
    """Opening and closing row of every rule."""
    host, path = _low(F.col("host")), F.coalesce("path", F.lit(""))
    clean = (
        rules.where("host <> '' AND verdict IS NOT NULL").select(host.alias("_h"), path.alias("_p"), "verdict")
        .groupBy("_h", "_p").agg(F.max("verdict").alias("verdict"))
    )
    key = _key(F.reverse(F.split("_h", r"\.")), F.col("_p"))
    rule = F.struct(
        F.length(F.concat("_h", "_p")).alias("size"), F.length("_h").alias("host_size"),
        F.concat("_h", "_p").alias("rule"), F.col("verdict"),
    )
    ends = F.array(
        F.struct(key.alias("_key"), F.lit(1).alias("_step"), rule.alias("_rule")),
        F.struct(F.concat(key, F.lit(END)).alias("_key"), F.lit(-1).alias("_step"), rule.alias("_rule")),
    )
    return clean.select(F.inline(ends)).withColumns({"_turn": F.lit(0), "_salt": F.lit(0).cast("bigint"), "_host": F.lit(None).cast("string"), "_path": F.lit(None).cast("string")})


def _tops(events: DataFrame) -> DataFrame:
    """``_host``, ``_path`` and the rule on top of the stack, for every key of a url that has one."""
    cut = slots(events, *ORDER)
    steps = cut.groupBy("_slot").agg(F.sum("_step").alias("_sum"))
    earlier = W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    starts = steps.select("_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    sofar = W.partitionBy("_slot").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    level = cut.withColumn("_level", F.sum("_step").over(sofar)).join(starts, "_slot").withColumn("_level", F.col("_level") + F.col("_base")).where("_step >= 0")
    # The rules that are open where a range begins: the last one opened at each depth in earlier ranges.
    opened = level.where("_step = 1").groupBy("_slot", "_level").agg(F.max_by("_rule", "_key").alias("_rule"))
    asked = starts.where("_base > 0").select("_slot", F.explode(F.sequence(F.lit(1).cast("bigint"), "_base")).alias("_level"))
    both = opened.withColumn("_asks", F.lit(0)).unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    before = W.partitionBy("_level").orderBy("_slot", F.desc("_asks")).rowsBetween(W.unboundedPreceding, 0)
    carried = both.withColumn("_open", F.last("_rule", ignorenulls=True).over(before)).where("_asks = 1").select("_slot", "_level", "_open")
    here = W.partitionBy("_slot", "_level").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    top = F.coalesce(F.last(F.when(F.col("_step") == 1, F.col("_rule")), ignorenulls=True).over(here), F.col("_open"))
    return (
        level.where("_level > 0").join(carried, ["_slot", "_level"], "left").withColumn("_top", top)
        .where("_turn = 1").select("_host", "_path", "_top")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``host``, ``path`` (null: empty) and ``verdict``. A rule fits
    its host and all subdomains, if the url's path starts with the rule's; the
    longest one wins, of equal length that with the longer host. Rules without
    host or verdict take no part; of equal rules the larger verdict holds
    (block). Without a rule ``rule`` is null and ``verdict`` the default. Urls
    that are null or have no ``://`` have an empty host, which no rule fits.
    Repeated pages keep a row each; other columns are not read.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    ends = _rule_ends(rules)
    # No rule is found by a suffix of more labels than any rule has.
    deepest = ends.agg(F.max(F.size(F.split(F.col("_rule.rule").substr(F.lit(1), F.col("_rule.host_size")), r"\.")))).first()[0] or 0
    labels = F.reverse(F.split("_host", r"\."))
    urls = rows.where("host <> ''").select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    many = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest))))
    keys = urls.select("_host", "_path", labels.alias("_labels"), F.explode(many).alias("_n")).select(
        "_host", "_path", _key(F.slice("_labels", F.lit(1), F.col("_n")), F.col("_path")).alias("_key"),
        F.lit(0).alias("_step"), F.lit(1).alias("_turn"), F.xxhash64("_host").alias("_salt"),
    )
    tops = _tops(ends.unionByName(keys, allowMissingColumns=True))
    best = tops.groupBy("_host", "_path").agg(F.max("_top").alias("_best"))
    return rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
