"""Problem 8: mixing sources to target shares of a token budget.

Every document gets a hash-random key per mix. Documents of a source are taken in the order of their keys: whole epochs as often as they fit the
source's budget (target_share * budget_tokens) and its cap allows, then the documents whose prefix sum of tokens stays within the rest. Prefix sums
are distributed: the key range of a source is cut into `buckets` equal ranges, summed first, and each range is summed up by itself from the total
of the ranges before it. A source of a third of all rows is spread over all its ranges.

Sources compare trimmed and lower-cased. A null source, or one that no mix names, is in no mix. Documents of 0 tokens (null and empty texts) are in
none. Equal texts under other ids count as documents. Ties of keys go by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.staging import staged

#: Documents of one key range, which one task sums up.
IN_RANGE = 20_000


def source_key(column: str) -> F.Column:
    return F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _targets(plans: DataFrame, targets: DataFrame) -> DataFrame:
    targets = targets.select("mix_name", "source", "target_share", "max_repeats")
    joined = targets.join(plans.select("mix_name", "budget_tokens"), "mix_name").withColumn("key", source_key("source"))
    return joined.withColumn("target_tokens", F.col("target_share") * F.col("budget_tokens"))


def available(sizes: DataFrame, plans: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, target_tokens, tokens, documents, short): each target with what its source holds.

    sizes: (id, source, n_tokens). short: not even max_repeats copies of every document reach the target.
    """
    held = sizes.groupBy(source_key("source").alias("key")).agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("documents"))
    rows = _targets(plans, targets).join(held, "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    short = F.col("max_repeats") * F.col("tokens") < F.col("target_tokens")
    return rows.withColumn("short", short).select("mix_name", "source", "key", "target_share", "max_repeats", "budget_tokens", "target_tokens", "tokens", "documents", "short")


def mixed(sizes: DataFrame, plans: DataFrame, targets: DataFrame, buckets: int | None = None) -> DataFrame:
    """(mix_name, source, id, n_tokens, copies): the documents of each mix, copies >= 1. buckets: key ranges of a source; unless given, so many that a
    range of the largest source has about IN_RANGE documents."""
    goal = staged(available(sizes, plans, targets).where("tokens > 0"))
    if buckets is None:
        buckets = max(16, -((goal.agg(F.max("documents")).first()[0] or 0) // -IN_RANGE))
    epochs = F.least(F.floor(F.col("target_tokens") / F.col("tokens")), F.col("max_repeats")).cast("bigint")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("target_tokens") - F.col("epochs") * F.col("tokens")).otherwise(0.0))
    docs = sizes.select("id", "source", "n_tokens").where("n_tokens > 0").withColumn("key", source_key("source")).drop("source").join(goal.select("mix_name", "source", "key", "epochs", "rest"), "key")
    docs = docs.withColumn("order", F.pmod(F.xxhash64("mix_name", "id"), F.lit(2**52))).withColumn("bucket", F.floor(F.col("order") / F.lit(2**52 / buckets)).cast("bigint"))
    group = ["mix_name", "source"]
    sums = docs.groupBy(*group, "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = docs.join(sums.select(*group, "bucket", before.alias("before")), [*group, "bucket"])
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*group, "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0))
    docs = docs.withColumn("copies", F.col("epochs") + F.when(upto <= F.col("rest"), 1).otherwise(0))
    return docs.where("copies > 0").select(*group, "id", "n_tokens", "copies")


def report(sizes: DataFrame, plans: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of `available` with what a mix really takes: actual_tokens, actual_documents, actual_share of the mix, budget_share of the budget.

    spent: every document of the source is in the mix max_repeats times. short: spent, and the target is not reached all the same; a source without
    any document is spent from the start.
    """
    full = F.count_if(F.col("copies") == F.col("max_repeats"))
    taken = mixed(sizes, plans, targets).join(targets.select("mix_name", "source", "max_repeats"), ["mix_name", "source"]).groupBy("mix_name", "source")
    taken = taken.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("actual_documents"), full.alias("full_documents"))
    rows = available(sizes, plans, targets).drop("key", "short").join(taken, ["mix_name", "source"], "left")
    for c in ("actual_tokens", "actual_documents", "full_documents"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    rows = rows.withColumn("spent", F.col("full_documents") == F.col("documents")).drop("full_documents")
    rows = rows.withColumn("short", F.col("spent") & (F.col("actual_tokens") < F.col("target_tokens")))
    whole = F.sum("actual_tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.try_divide(F.col("actual_tokens"), whole)).withColumn("budget_share", F.try_divide(F.col("actual_tokens"), F.col("budget_tokens")))
