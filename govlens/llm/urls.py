"""URL filter: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Each URL is expanded into the expressions that a rule of the table could have (host suffixes by number of
labels, path prefixes by length), the expressions are hashed, and an equi-join on a short prefix of the digest
finds candidate rules. The full digest confirms a candidate; of the rules that fit, the longest wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.llm.common import ascii_lower

#: (action, host, path) of the rules that a query applies when it is given none.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hex digits of the digest on which expressions and rules are joined; the digest itself confirms.
PREFIX_DIGITS = 8


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as a table of action, host and path."""
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased) and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return pages.select("*", ascii_lower(host).alias("host"), F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", digits: int = PREFIX_DIGITS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null where none fits), verdict.

    A null url, one without ``://`` or one with an empty host or path has empty parts, fits no rule with a path and
    gets ``default``. Repeated rows stay repeated. Other columns of pages are not read. Equal rules of different
    action count as one: ``block`` wins. An empty rule table gives ``default`` throughout.
    """
    rules = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    expression = F.concat_ws("\n", "host", "path")
    keyed = rules.select(
        F.sha2(expression, 256).alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        "action",
        F.struct(F.length("host") + F.length("path"), F.length("host")).alias("rank"),
    ).withColumn("prefix", F.substring("rule_digest", 1, digits))
    # the shapes that rules have: a handful of pairs of (labels of the host, length of the path)
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct()
    shapes = [(r.labels, r.chars) for r in shapes.collect()]

    parts = host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path")
    keys = parts.filter(F.col("host") != "").groupBy("host", "path").agg(F.lit(1).alias("seen"))
    n_labels = F.size(F.split("host", r"\."))
    texts = [
        F.when(
            (n_labels >= labels) & (F.length("path") >= chars),
            F.concat_ws("\n", F.substring_index("host", ".", -labels), F.substring("path", 1, chars)),
        )
        for labels, chars in shapes
    ]
    expressions = F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")
    probes = keys.select("host", "path", F.explode(expressions).alias("expression"))
    probes = probes.select("host", "path", F.sha2("expression", 256).alias("digest"))
    probes = probes.withColumn("prefix", F.substring("digest", 1, digits))
    best = (
        probes.join(keyed, "prefix")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rank", "rule", "action")).alias("best"))
        .select("host", "path", "best.rule", "best.action")
    )
    # rows without a host fit no rule: they are spread, so that many of them don't meet; the others' rules are dealt once more, so that a url
    # that is there very often can be split
    parts = parts.withColumn("apart", F.when(F.col("host") == "", F.pmod(F.xxhash64("page_id"), F.lit(1000)) + 1).otherwise(0))
    best = best.withColumn("apart", F.lit(0).cast("long")).repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.join(best, ["host", "path", "apart"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )
