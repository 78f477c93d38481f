"""Ranking metrics, routing-case metrics, token accounting and reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import discard, folder, stored

RANGE_ROWS = 1_000_000


def ranked_metrics(predictions: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """predictions: task_id, doc_id, rank; qrels: task_id, doc_id, relevance. One row for each task with a positive grade.

    A document that is listed twice counts at its best rank. A task's list is ranked in one task: it is what a ranker returned.
    Of the gold only the first k are ranked, and only as many leave each task before the shuffle.
    """
    qrels = qrels.where("relevance > 0").groupBy("task_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    best = predictions.groupBy("task_id", "doc_id").agg(F.min("rank").alias("rank"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("task_id").orderBy("rank")))
    hit = best.join(qrels, ["task_id", "doc_id"])
    hit = hit.withColumn("seen", F.row_number().over(W.partitionBy("task_id").orderBy("rank")))
    gain = lambda grade, place: (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1.0)
    inside = F.col("rank") <= k
    found = hit.groupBy("task_id").agg(
        F.min("rank").alias("first"),
        F.sum(inside.cast("int")).alias("found"),
        F.sum(F.when(inside, gain(F.col("relevance"), F.col("rank")))).alias("dcg"),
        F.sum(F.when(inside, F.col("seen") / F.col("rank"))).alias("precision_sum"),
    )
    order = qrels.withColumn("place", F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("relevance"))))
    ideal = order.where(F.col("place") <= k).groupBy("task_id").agg(F.sum(gain(F.col("relevance"), F.col("place"))).alias("ideal"))
    held = qrels.groupBy("task_id").agg(F.count("*").alias("gold")).join(ideal, "task_id").join(found, "task_id", "left")
    n = F.coalesce("found", F.lit(0))
    return held.select(
        "task_id",
        F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("hit1"),
        F.round(n / F.col("gold"), 9).alias("recall"),
        F.round(n / F.lit(k), 9).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("mrr"),
        F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 9).alias("ndcg"),
        F.round(F.coalesce(F.col("precision_sum"), F.lit(0.0)) / F.least(F.col("gold"), F.lit(k)), 9).alias("map"),
        (n == F.col("gold")).cast("int").alias("completeness"),
    )


def macro_mean(per_task: DataFrame, *keys: str) -> DataFrame:
    names = [c for c in per_task.columns if c not in ("task_id", *keys)]
    return per_task.groupBy(*keys).agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 9).alias(c) for c in names))


def case_metrics(cases: DataFrame, *keys: str) -> DataFrame:
    """cases: selected, expected, forbidden (arrays of different ids) and keys. Totals and rates; undefined rates are 1."""
    tp = F.size(F.array_intersect("selected", "expected"))
    held = cases.select(*keys, "selected", tp.alias("tp"), (F.size("selected") - tp).alias("fp"), (F.size("expected") - tp).alias("fn"), F.size(F.array_intersect("selected", "forbidden")).alias("forbidden_hits"), (F.size("expected") > 0).alias("positive"), F.array_contains("expected", F.get("selected", 0)).alias("first"), F.get(F.filter(F.transform("selected", lambda x, i: F.when(F.array_contains("expected", x), i + 1)), lambda x: x.isNotNull()), 0).alias("place"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(1.0)), 9)
    when = lambda c, v: F.when(c, v)
    pos, neg = F.col("positive"), ~F.col("positive")
    return held.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("int")).alias("exact"),
        F.sum("forbidden_hits").alias("forbidden"),
        rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.round(F.avg(when(pos, F.coalesce(F.col("first"), F.lit(False)).cast("int"))), 9).alias("hit1"),
        F.round(F.avg(when(pos, F.col("place").isNotNull().cast("int"))), 9).alias("hitk"),
        F.round(F.avg(when(pos, F.coalesce(1 / F.col("place"), F.lit(0.0)))), 9).alias("mrr"),
        F.round(F.avg(when(neg, (F.size("selected") == 0).cast("int"))), 9).alias("abstained"),
    )


def stability(runs: DataFrame) -> DataFrame:
    """runs: case_id, selected. The share of cases with one selection over all runs."""
    return runs.groupBy("case_id").agg((F.count_distinct(F.to_json("selected")) == 1).cast("int").alias("same")).agg(F.round(F.avg("same"), 9).alias("stability"))


def nearest_ranks(df: DataFrame, column: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, one column a share): the least value that at least this share of a group's values do not exceed; exact.

    Values are counted, and the different ones are dealt by range, about ``RANGE_ROWS`` each: a group of any size is many ranges,
    of which only the ones that hold a wanted rank are ordered. Null values do not count; a group of nulls only has no row.
    """
    spark = df.sparkSession
    work = folder(spark, "ranks")
    held = df.where(F.col(column).isNotNull())
    counts = stored(held.groupBy(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(column).alias("value")).agg(F.count("*").alias("n")), "counts", work)
    names = [f"k{i}" for i in range(len(keys))]
    ranges = max(1, -(-counts.count() // RANGE_ROWS))
    dealt = stored(counts.repartitionByRange(ranges, *names, "value").withColumn("range", F.spark_partition_id()), "ranges")
    discard(spark, work)
    sums = dealt.groupBy(*names, "range").agg(F.sum("n").alias("here"))
    before = F.coalesce(F.sum("here").over(W.partitionBy(*names).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).withColumn("all", F.sum("here").over(W.partitionBy(*names)))
    wanted = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("all"))).alias("rank")) for s, p in shares.items())))
    sums = sums.withColumn("w", wanted).where((F.col("w.rank") > F.col("before")) & (F.col("w.rank") <= F.col("before") + F.col("here")))
    sums = sums.select(*(F.col(k).alias(f"s{k}") for k in names), F.col("range").alias("at"), "before", F.col("w.share").alias("share"), F.col("w.rank").alias("rank"))
    inside = reduce(and_, (F.col(k).eqNullSafe(F.col(f"s{k}")) for k in names), F.col("range") == F.col("at"))
    upto = F.col("before") + F.sum("n").over(W.partitionBy(*names, "share").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    found = dealt.join(sums, inside).withColumn("upto", upto).where(F.col("upto") >= F.col("rank")).groupBy(*names, "share").agg(F.min("value").alias("value"))
    out = found.groupBy(*names).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(s) for s in shares))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), *shares)


def latency(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Nearest-rank p50 and p95, and the maximum; a group of nulls only has nulls."""
    top = df.groupBy(*keys).agg(F.max(column).alias("longest"))
    ranks = nearest_ranks(df, column, list(keys), {"p50": 0.5, "p95": 0.95})
    ranks = ranks.select(*(F.col(k).alias(f"r{i}") for i, k in enumerate(keys)), "p50", "p95")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"r{i}")) for i, k in enumerate(keys)), F.lit(True))
    return top.join(ranks, same, "left").select(*keys, "p50", "p95", "longest")


def method_histogram(cases: DataFrame) -> DataFrame:
    """cases: methods (array). How often each method selected; an empty selection counts as ``none``."""
    return cases.select(F.explode_outer("methods").alias("method")).select(F.coalesce("method", F.lit("none")).alias("method")).groupBy("method").agg(F.count("*").alias("n"))


def scorable_tasks(gold: DataFrame) -> DataFrame:
    """gold: task_id, task_type, doc_ids (array). Tasks of the type ``generic_only`` and tasks without gold are not scored."""
    return gold.where((F.size("doc_ids") > 0) & (F.coalesce("task_type", F.lit("")) != "generic_only"))


def token_accounting(predictions: DataFrame, catalog: DataFrame, load: int = 2) -> DataFrame:
    """The catalog's names and descriptions for each query against the bodies of the first ``load`` documents of each prediction.

    A prediction that names a document outside the catalog is an error.
    """
    total = catalog.agg(F.coalesce(F.sum("activation_tokens"), F.lit(0)).alias("catalog_tokens"))
    asked = predictions.agg(F.count_distinct("task_id").alias("queries"))
    held = predictions.where(F.col("rank") <= load).join(catalog.select("doc_id", F.col("full_tokens").alias("tokens"), F.lit(1).alias("known")), "doc_id", "left")
    loaded = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("loaded_tokens"), F.count(F.when(F.col("known").isNull(), 1)).alias("missing"))
    held = total.join(asked, F.lit(True)).join(loaded, F.lit(True))
    before = F.col("catalog_tokens") * F.col("queries")
    sure = F.when(F.col("missing") > 0, F.raise_error(F.concat(F.col("missing").cast("string"), F.lit(" predicted documents are not in the catalog"))).cast("long")).otherwise(F.col("loaded_tokens"))
    held = held.withColumn("loaded_tokens", sure)
    return held.select("queries", "catalog_tokens", "loaded_tokens", before.alias("baseline_tokens"), (before - F.col("loaded_tokens")).alias("avoided_tokens"), F.round(F.coalesce(F.try_divide(before - F.col("loaded_tokens"), before), F.lit(0.0)), 9).alias("reduction"))


def selection_accounting(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """cases: case_id, doc_ids (what was selected). Names and descriptions that no longer load, and the bodies that do."""
    before = catalog.agg(F.coalesce(F.sum("activation_tokens"), F.lit(0)).alias("tokens_before"))
    picked = cases.select("case_id", F.explode("doc_ids").alias("doc_id")).join(catalog.select("doc_id", "full_tokens"), "doc_id").agg(F.coalesce(F.sum("full_tokens"), F.lit(0)).alias("selected_tokens"))
    held = before.join(picked, F.lit(True)).join(cases.agg(F.count("*").alias("cases")), F.lit(True))
    return held.select("cases", "tokens_before", F.lit(0).cast("long").alias("tokens_after"), F.col("tokens_before").alias("tokens_avoided"), "selected_tokens", F.round(F.col("selected_tokens") / F.greatest("cases", F.lit(1)), 9).alias("mean_selected_tokens"))


def retention_given_retrieval(turns: DataFrame) -> DataFrame:
    """turns: expected, retrieved, resident (arrays). Of turns with gold: the shares retrieved and resident, and the resident share where some gold was retrieved."""
    share = lambda c: F.size(F.array_intersect("expected", c)) / F.size("expected")
    held = turns.where(F.size("expected") > 0).select(share("retrieved").alias("retrieved"), share("resident").alias("resident"))
    return held.agg(F.round(F.avg("retrieved"), 9).alias("gold_retrieved"), F.round(F.avg("resident"), 9).alias("gold_resident"), F.round(F.avg(F.when(F.col("retrieved") > 0, F.col("resident"))), 9).alias("memory_retention"))


def turn_metrics(turns: DataFrame) -> DataFrame:
    """turns: expected, resident, injected, summarized, forbidden (arrays), tokens. Means over turns; undefined ones are left out."""
    held = F.size(F.array_intersect("expected", "resident"))
    some = F.size("expected") > 0
    f1 = F.when(some, 2 * held / (F.size("expected") + F.size("resident")))
    missed = F.array_except("expected", "resident")
    out = turns.select(
        f1.alias("f1"),
        F.when(some, held / F.size("expected")).alias("coverage"),
        F.when(held > 0, F.size(F.array_except(F.array_intersect("expected", "resident"), "injected")) / held).alias("reuse"),
        F.when(F.size(missed) > 0, F.size(F.array_intersect(missed, "summarized")) / F.size(missed)).alias("recovery"),
        F.when(~some, (F.size("injected") == 0).cast("int")).alias("abstained"),
        F.size(F.array_intersect("resident", "forbidden")).alias("forbidden"),
        "tokens",
    )
    return out.agg(*(F.round(F.avg(c), 9).alias(c) for c in ("f1", "coverage", "reuse", "recovery", "abstained", "tokens")), F.sum("forbidden").alias("forbidden"))


def retention(compactions: DataFrame) -> DataFrame:
    """compactions: expected, restored. The mean share of what should survive that was restored."""
    share = F.when(F.size("expected") > 0, F.size(F.array_intersect("expected", "restored")) / F.size("expected"))
    return compactions.agg(F.round(F.avg(share), 9).alias("retention"), F.count(share).alias("compactions"))


def progress(log: DataFrame, totals: DataFrame, now: Column, active_seconds: int = 600) -> DataFrame:
    """log: run_id, at, n; totals: run_id, total. Completed share and whether a run is complete, active or paused."""
    done = log.groupBy("run_id").agg(F.sum("n").alias("completed"), F.max("at").alias("last"))
    held = totals.join(done, "run_id", "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    recent = F.unix_timestamp(now) - F.unix_timestamp("last") <= active_seconds
    status = F.when(F.col("completed") >= F.col("total"), "complete").when(recent, "active").otherwise("paused")
    return held.select("run_id", "completed", "total", status.alias("status"))


def side_by_side(*reports: DataFrame) -> DataFrame:
    """Reports of different families as rows; columns that a family lacks are null, nothing is averaged."""
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
