"""Session features in batch: access features, policy orders, working sets, repeated prompts, associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def indexed(log: DataFrame) -> DataFrame:
    """log: session, item, ts, event_id. ``now``: how many events the session had, this one included."""
    return log.withColumn("now", F.row_number().over(W.partitionBy("session").orderBy("ts", "event_id")))


def access_features(log: DataFrame) -> DataFrame:
    """log: session, item, now. First, last, hits after the first, and the order of insertion."""
    held = log.groupBy("session", "item").agg(F.min("now").alias("first_use"), F.max("now").alias("last_use"), (F.count("*") - 1).alias("hits"))
    return held.withColumn("insert_seq", F.row_number().over(W.partitionBy("session").orderBy("first_use", "item")))


def first_injections(log: DataFrame) -> DataFrame:
    """injected: the first time an item is selected in a session; later ones meet the resident set."""
    place = F.row_number().over(W.partitionBy("session", "item").orderBy("now"))
    return log.withColumn("injected", place == 1)


def policy_order(policy: str) -> list[Column]:
    """lru: last use; lfu: hits, then last use; index: order of insertion."""
    orders = {"lru": [F.desc("last_use")], "lfu": [F.desc("hits"), F.desc("last_use")], "index": []}
    return [*orders[policy], F.col("insert_seq")]


def restore_order(features: DataFrame, policy: str, span: int = 10) -> DataFrame:
    """What was used in the last ``span`` prompts first, each part by policy."""
    now = F.max("last_use").over(W.partitionBy("session"))
    held = features.withColumn("in_working_set", F.col("last_use") > now - span)
    w = W.partitionBy("session").orderBy(F.desc("in_working_set"), *policy_order(policy))
    return held.withColumn("place", F.row_number().over(w))


def stale(features: DataFrame, now: Column, after: int = 20) -> DataFrame:
    return features.where((F.col("last_injected") > 0) & (now - F.col("last_injected") >= after))


def repeated_prompts(prompts: DataFrame) -> DataFrame:
    """prompts: session, prompt_key, now, selection. The selection of the same prompt before in the session, if any."""
    w = W.partitionBy("session", "prompt_key").orderBy("now").rowsBetween(W.unboundedPreceding, -1)
    return prompts.withColumn("reused", F.last("selection", ignorenulls=True).over(w))


def summary_spacing(offers: DataFrame, apart: int = 10) -> DataFrame:
    """offers: session, item, now. Shown if not shown within the last ``apart`` prompts; a fold, as it reads its own output."""
    lists = offers.groupBy("session", "item").agg(F.sort_array(F.collect_set("now")).alias("at"))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("shown"))

    def step(acc: Column, n: Column) -> Column:
        return F.when(acc["last"].isNull() | (n - acc["last"] >= apart), F.struct(n.alias("last"), F.concat(acc["shown"], F.array(n)).alias("shown"))).otherwise(acc)

    return lists.select("session", "item", F.explode(F.aggregate("at", start, step, lambda acc: acc["shown"])).alias("now"))


def trace_tail(log: DataFrame, limit: int = 20) -> DataFrame:
    """The last events in ascending order: TakeOrderedAndProject, then a sort of the few."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).orderBy("ts", "event_id")


def pair_counts(baskets: DataFrame, min_support: int = 2, basket_items: int = 2_000) -> DataFrame:
    """baskets: basket, item. (a, b, support) of different items of one basket, both ways.

    An item of fewer than ``min_support`` baskets is in no pair of that support and goes before pairing. A basket of more than
    ``basket_items`` items is cut into parts, and every two parts (and each with itself) meet apart: no basket is one task.
    """
    held = baskets.where("basket is not null and item is not null").distinct()
    if min_support > 1:
        held = held.join(held.groupBy("item").count().where(F.col("count") >= min_support).select("item"), "item", "left_semi")
    large = held.groupBy("basket").count().where(F.col("count") > basket_items).select("basket", F.ceil(F.col("count") / basket_items).cast("int").alias("parts"))
    held = held.join(large, "basket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = held.withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    low = held.select("basket", F.col("item").alias("x"), F.col("part").alias("low"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("high"))
    high = held.select("basket", F.col("item").alias("y"), F.explode(F.sequence(F.lit(0), "part")).alias("low"), F.col("part").alias("high"))
    pairs = low.join(high, ["basket", "low", "high"]).where("low < high or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    one_way = pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    return one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "support"))


def associations(baskets: DataFrame, min_support: int = 2, limit: int = 2) -> DataFrame:
    """(a, b, support, confidence, rank): what most often goes with each item; confidence is count(a, b) / count(a)."""
    items = baskets.distinct().groupBy(F.col("item").alias("a")).agg(F.count("*").alias("n"))
    held = pair_counts(baskets, min_support).join(items, "a").select("a", "b", "support", F.round(F.col("support") / F.col("n"), 9).alias("confidence"))
    return held.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("confidence"), F.desc("support"), F.col("b")))).where(F.col("rank") <= limit)


def predict_next(selected: DataFrame, rules: DataFrame, limit: int = 2) -> DataFrame:
    """selected: key, item. The best associated items of each key that are not selected already."""
    held = selected.join(rules, selected.item == rules.a).groupBy("key", F.col("b").alias("item")).agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"))
    held = held.join(selected.select("key", "item"), ["key", "item"], "left_anti")
    return held.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("confidence"), F.desc("support"), F.col("item")))).where(F.col("rank") <= limit)
