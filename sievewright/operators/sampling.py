"""Deterministic dataset sampling and the building of session suites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

SALTS = 64


def stratified_sample(rows: DataFrame, key: str, stratum: str, size: int, seed: str) -> DataFrame:
    """Largest-remainder seats for each stratum, then the first by hash within it. Counts by stratum are one small row each."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.least(F.lit(size), F.col("total")) * F.col("n") / F.col("total")
    seats = counts.join(F.broadcast(total), F.lit(True)).select(stratum, F.floor(share).alias("seats"), (share - F.floor(share)).alias("rest"), F.least(F.lit(size), F.col("total")).alias("size"))
    left = F.col("size") - F.sum("seats").over(W.partitionBy(F.lit(1)))
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("rest"), F.desc(stratum)))
    seats = seats.withColumn("left", left).withColumn("place", place).select(stratum, (F.col("seats") + (F.col("place") <= F.col("left")).cast("int")).alias("seats"))
    rank = tx.stable_rank(seed, F.col(key))
    first_of = lambda df, *by: df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(rank))).where(F.col("place") <= size)
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    first = first_of(first_of(rows.withColumn("salt", salt), stratum, "salt").drop("salt"), stratum)  # a stratum is ranked in parts, then the firsts of the parts
    return first.join(F.broadcast(seats), stratum).where("place <= seats").drop("place", "seats")


def required_ids(qrels: DataFrame, tasks: DataFrame) -> DataFrame:
    """The documents with a positive grade for one of the tasks."""
    return qrels.where("relevance > 0").join(tasks.select("task_id"), "task_id", "left_semi").select("doc_id").distinct()


def hash_fill(pool: DataFrame, chosen: DataFrame, size: int, seed: str, key: str = "doc_id") -> DataFrame:
    """The first ``size`` of the pool by hash that are not chosen yet."""
    return pool.select(key).join(chosen, key, "left_anti").orderBy(tx.stable_rank(seed, F.col(key)), F.col(key)).limit(size)


def fill_pool(chosen: DataFrame, others: DataFrame, size: int, seed: str, key: str = "doc_id") -> DataFrame:
    """The chosen ids, and as many of the others by 48-bit hash as the pool size leaves room for."""
    chosen = chosen.select(key).distinct()
    room = max(0, size - chosen.count())
    more = others.select(key).distinct().join(chosen, key, "left_anti").orderBy(tx.stable_rank48(seed, F.col(key)), F.col(key)).limit(room)
    return chosen.withColumn("chosen", F.lit(True)).unionByName(more.withColumn("chosen", F.lit(False)))


def hard_negatives(pool: DataFrame, tasks: DataFrame, chosen: DataFrame, size: int, seed: str) -> DataFrame:
    """The documents that share most words with a task: overlap of word sets, the best over tasks; ties by hash."""
    asked = tasks.select("task_id", F.explode(tx.sampler_words(F.col("text"))).alias("w"))
    n = asked.groupBy("task_id").agg(F.count("*").alias("n"))
    meta = pool.join(chosen, "doc_id", "left_anti").select("doc_id", F.explode(tx.sampler_words(F.concat_ws(" ", "name", "description"))).alias("w"))
    shared = meta.join(asked, "w").groupBy("doc_id", "task_id").agg(F.count("*").alias("shared")).join(n, "task_id")
    best = shared.groupBy("doc_id").agg(F.round(F.max(F.col("shared") / F.col("n")), 9).alias("overlap"))
    return best.orderBy(F.desc("overlap"), tx.stable_rank(seed, F.col("doc_id")), F.desc("doc_id")).limit(size)


def _variants(pool: DataFrame, gold: DataFrame) -> DataFrame:
    held = pool.select("doc_id", F.regexp_extract("doc_id", r"^distractor/dist_(.+)_[0-9a-f]+$", 1).alias("target"))
    return held.join(gold.select(F.col("doc_id").alias("target")).distinct(), "target", "left_semi")


def targeted_variants(pool: DataFrame, gold: DataFrame, budget: int, seed: str) -> DataFrame:
    """Ids ``distractor/dist_<gold>_<hex>`` whose target is selected, by hash within the budget."""
    return _variants(pool, gold).orderBy(tx.stable_rank(seed, F.col("doc_id"))).limit(budget)


def variant_counts(pool: DataFrame, gold: DataFrame, budget: int) -> DataFrame:
    """(variants, kept, dropped): how many variants there are and how many the budget leaves out."""
    n = F.col("variants")
    return _variants(pool, gold).agg(F.count("*").alias("variants")).select("variants", F.least(n, F.lit(budget)).alias("kept"), F.greatest(n - budget, F.lit(0)).alias("dropped"))


def required_in_pool(core: DataFrame, pool: DataFrame, budget: int) -> DataFrame:
    """The different core ids; ids that the pool lacks and a budget under their number are errors."""
    core = core.select("doc_id").distinct()
    found = core.join(pool.select("doc_id", F.lit(1).alias("there")).distinct(), "doc_id", "left").agg(F.count("*").alias("n"), F.count(F.when(F.col("there").isNull(), 1)).alias("absent")).first()
    if found.absent:
        raise ValueError(f"{found.absent} required documents are not in the pool")
    if found.n > budget:
        raise ValueError(f"{found.n} documents are required, the budget is {budget}")
    return core


def single_gold_groups(qrels: DataFrame, least: int = 2) -> DataFrame:
    """Documents that are the only gold of ``least`` or more queries."""
    one = qrels.where("relevance > 0").groupBy("query_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return one.groupBy("doc_id").agg(F.count("*").alias("queries")).where(F.col("queries") >= least)


ARCHETYPES = [("focused", 1), ("drift", 4), ("return", 4)]


def deal_blocks(docs: DataFrame, sessions: int, seed: str, key: str = "doc_id", block: int = 0) -> DataFrame:
    """Documents in hash order, dealt to sessions of each archetype. Only as many as are needed are ordered.

    ``block`` 0 is the first block of that order, 1 the next one, held out from it, and so on; too few documents are an error.
    """
    need = sessions * sum(n for _, n in ARCHETYPES)
    first = docs.select(key).withColumn("h", tx.stable_rank(seed, F.col(key))).orderBy("h", key).limit(need * (block + 1))
    there = first.count()
    if there < need * (block + 1):
        raise ValueError(f"{need * (block + 1)} documents are needed for block {block} of {sessions} sessions, {there} are there")
    held = first.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("h", key)) - 1 - need * block)
    out, at = [], 0
    for name, n in ARCHETYPES:
        out.append(held.where(F.col("place").between(at, at + n * sessions - 1)).select(key, F.lit(name).alias("archetype"), F.floor((F.col("place") - at) / n).cast("long").alias("session"), ((F.col("place") - at) % n).cast("long").alias("slot")))
        at += n * sessions
    return out[0].unionByName(out[1]).unionByName(out[2])


def session_turns(blocks: DataFrame, queries: DataFrame, seed: str, turns: int = 2) -> DataFrame:
    """blocks as of deal_blocks; queries: query_id, doc_id. The first queries by hash of each slot's document are its turns."""
    order = F.row_number().over(W.partitionBy("doc_id").orderBy(tx.stable_rank(seed, F.col("query_id"))))
    asked = queries.join(blocks.select("doc_id"), "doc_id", "left_semi").withColumn("visit", order).where(F.col("visit") <= turns)
    held = blocks.join(asked, "doc_id")
    turn = F.row_number().over(W.partitionBy("archetype", "session").orderBy("visit", "slot"))
    return held.select("archetype", "session", turn.alias("turn"), "doc_id", "query_id")


def routing_cases(catalog: DataFrame, negatives: list[str]) -> DataFrame:
    """``name: description`` expects its own document; fixed prompts expect none."""
    own = catalog.select(F.concat_ws(": ", "name", "description").alias("prompt"), F.col("doc_id").cast("string").alias("expected"))
    none = catalog.sparkSession.createDataFrame([(p, None) for p in negatives], "prompt string, expected string")
    return own.unionByName(none)


def write_sample(tasks: DataFrame, grades: DataFrame, pool: DataFrame, selected: DataFrame, path: str) -> DataFrame:
    """Tasks, their grades of selected documents and the selected pool as tables below ``path``; the statistics go there too and are returned.

    tasks: task_id, ...; grades: task_id, doc_id, relevance; pool: doc_id, ...; selected: doc_id. A selected document that the
    pool lacks is an error; an existing sample is not written over.
    """
    absent = selected.join(pool.select("doc_id"), "doc_id", "left_anti").count()
    if absent:
        raise ValueError(f"{absent} selected documents are not in the pool")
    kept = grades.join(tasks.select("task_id"), "task_id", "left_semi").join(selected, "doc_id", "left_semi")
    for name, df in (("tasks", tasks), ("grades", kept), ("pool", pool.join(selected, "doc_id", "left_semi"))):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    held = {name: pool.sparkSession.read.parquet(f"{path}/{name}") for name in ("tasks", "pool", "grades")}
    statistics = sample_statistics(held["tasks"], held["pool"], held["grades"].where("relevance > 0").select("doc_id").distinct())
    statistics.write.mode("errorifexists").json(f"{path}/statistics")
    return statistics


def sample_statistics(tasks: DataFrame, pool: DataFrame, required: DataFrame) -> DataFrame:
    return tasks.agg(F.count("*").alias("tasks")).join(pool.agg(F.count("*").alias("pool")), F.lit(True)).join(required.agg(F.count("*").alias("required")), F.lit(True))
