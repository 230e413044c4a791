"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each url becomes the expressions ``host-suffix + path-prefix`` under which a rule could name it: every
suffix of the host at a label's start with no more labels than some rule's host has, with every prefix of the path as
long as some rule's path. Their
SHA-256 digests are joined with the rules' on the first 4 bytes; the full digest then confirms a hit, and
the longest rule wins (a tie goes to the longer host, then to ``block``).

Only DataFrame functions are used. The rules are broadcast only if there are at most ``broadcast_rules``
of them (a counted bound); more rules are joined by shuffling on the hash prefix, where Spark splits
skewed partitions.

Cases: a null url or one without ``://`` has an empty host and path, no rule and the default verdict.
Rows are judged one by one, so repeated rows and null ids stay; repeated rules count once, and of rules with
equal host and path the verdict last in order (``block`` over ``allow``) holds. An empty table or no rules give an empty
result or default verdicts. Very long urls have no more expressions than short ones. Columns other than id and url are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_BYTES = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, ``host/path``) as a table of verdict, host, path."""
    split = [(v, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(split, "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, path), 256))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (``host`` + ``path`` of the winner, else null), verdict."""
    rules = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\.", -1))).alias("labels")).first()
    lengths = sorted(known["lengths"]) or [0]  # distinct path lengths, no more than the longest path has characters

    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.", -1)
    most = F.least(F.size(labels), F.lit(known["labels"] or 1))
    suffixes = F.transform(F.sequence(F.size(labels) - most + 1, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    exprs = base.withColumn("h", F.explode_outer(suffixes)).withColumn("p", F.explode_outer(prefixes))
    exprs = exprs.withColumn("digest", _digest(F.col("h"), F.col("p"))).withColumn("prefix", F.substring("digest", 1, PREFIX_BYTES))

    side = rules.select("verdict", F.length("host").alias("host_len"), F.concat("host", "path").alias("rule"), _digest(F.col("host"), F.col("path")).alias("rule_digest"))
    side = side.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_BYTES))
    if known["n"] <= broadcast_rules:
        side = F.broadcast(side)
    hits = exprs.join(side, "prefix", "left").withColumn("hit", (F.col("digest") == F.col("rule_digest")) & (F.length("h") == F.col("host_len")))
    best = F.max(F.when(F.col("hit"), F.struct(F.length("rule").alias("len"), "host_len", "verdict", "rule"))).alias("best")
    out = hits.groupBy("row", "id", "host", "path").agg(best)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
