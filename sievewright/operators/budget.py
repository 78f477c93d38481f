"""Admission under token budgets. Lists are ranked rows of one prompt, at most a few dozen, so folds stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def prefix_budget(items: DataFrame, budget: int, key: str = "prompt_id", order: str = "rank", cost: str = "tokens") -> DataFrame:
    """Walk in order, stop before the first overflow. Costs are positive, so a running sum says it."""
    running = F.sum(cost).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return items.withColumn("running", running).where(F.col("running") <= budget)


def greedy_budget(items: DataFrame, budget: int, force_first: bool = False) -> DataFrame:
    """items: prompt_id, rank, doc_id, tokens, content_hash. (prompt_id, rank, doc_id, tokens, reason); reason null: loaded.

    Texts that were loaded already and items that do not fit are skipped with a reason; after the budget is full nothing
    more is looked at. With ``force_first`` the first item is always loaded and texts are not compared.
    """
    item = F.struct("rank", "doc_id", "tokens", "content_hash")
    lists = items.groupBy("prompt_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    row = "struct<rank:int,doc_id:bigint,tokens:bigint,reason:string>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{row}>").alias("out"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        again = F.lit(False) if force_first else F.array_contains(acc["seen"], x["content_hash"])
        fits = acc["used"] + x["tokens"] <= budget
        if force_first:
            fits = fits | (F.size(acc["seen"]) == 0)
        reason = F.when(again, "duplicate-content").when(~fits, "token-budget")
        load = ~again & fits
        used = (acc["used"] + F.when(load, x["tokens"]).otherwise(0)).cast("long")
        one = F.struct(x["rank"].cast("int").alias("rank"), x["doc_id"].cast("long").alias("doc_id"), x["tokens"].cast("long").alias("tokens"), reason.alias("reason"))
        new = F.struct(used.alias("used"), F.when(load, F.concat(acc["seen"], F.array(x["content_hash"]))).otherwise(acc["seen"]).alias("seen"), F.concat(acc["out"], F.array(one)).alias("out"), (used >= budget).alias("full"))
        return F.when(acc["full"], acc).otherwise(new)

    return lists.select("prompt_id", F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("x")).select("prompt_id", "x.*")


def newest_first_budget(notes: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """notes: key, seq, tokens, ... The newest that fit as a prefix; the newest itself always stays."""
    w = W.partitionBy(key).orderBy(F.desc("seq"))
    held = notes.withColumn("place", F.row_number().over(w)).withColumn("running", F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return held.where((F.col("place") == 1) | (F.col("running") <= budget)).drop("place", "running")


def last_notes(notes: DataFrame, keep: int = 12, key: str = "doc_id") -> DataFrame:
    """The last different notes of each document; a note that is added again moves to the end."""
    latest = notes.groupBy(key, "note").agg(F.max("seq").alias("seq"))
    return latest.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq"), F.col("note")))).where(F.col("place") <= keep).drop("place")


def assemble(loaded: DataFrame, catalog: DataFrame) -> DataFrame:
    """One context string for each prompt: loaded rows (prompt_id, rank, doc_id) rendered in order."""
    one = F.concat(F.lit('<document name="'), tx.escape_attr(F.col("name")), F.lit('" provider="'), tx.escape_attr(F.col("provider")), F.lit('">\n'), "body", F.lit("\n</document>"))
    held = loaded.join(catalog.select("doc_id", one.alias("rendered")), "doc_id")
    return held.groupBy("prompt_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "rendered"))), lambda x: x["rendered"]), "\n").alias("context"))


HEADING = r"(?m)^(?=[ \t]*##[ \t]+\S)"


def select_sections(docs: DataFrame, budget: int = 1200, gate: int = 2000, least: int = 1) -> DataFrame:
    """docs: doc_id, prompt, body. (doc_id, body, dropped): sections by terms shared with the prompt, admitted greedily, in their own order.

    A section begins at a line with a second-level heading. Front matter and what stands before the first section always
    stay and are paid first; ``least`` sections stay whatever they cost; a note tells how many went. Bodies of up to ``gate``
    tokens, bodies of up to ``least`` sections and bodies of which all sections fit are left as they are.
    """
    text = F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n", "\n")
    front = F.regexp_extract(text, r"\A[ \t]*---[ \t]*\n(?:[\s\S]*?\n)??[ \t]*---[ \t]*(?:\n|\z)", 0)
    rest = F.substr(text, F.length(front) + F.lit(1))
    pieces = F.split(F.regexp_replace(F.translate(rest, "\x01", " "), HEADING, "\x01"), "\x01")
    held = docs.where(tx.estimate_tokens(F.col("body")) > gate).select("doc_id", F.array_distinct(tx.raw_terms(F.col("prompt"))).alias("q"), front.alias("front"), pieces.alias("pieces"))
    held = held.where(F.size("pieces") > least + 1).withColumn("spent", tx.estimate_tokens(F.concat("front", F.element_at("pieces", 1))))

    def weighed(piece: Column, i: Column) -> Column:
        shared = F.size(F.array_intersect("q", tx.raw_terms(piece)))
        return F.struct((-shared).alias("share"), i.alias("at"), tx.estimate_tokens(piece).alias("tokens"))

    ranked = F.sort_array(F.filter(F.transform("pieces", weighed), lambda x: x["at"] > 0))
    start = F.struct(F.col("spent").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["tokens"] <= budget) | (F.size(acc["kept"]) < least)
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["kept"], F.array(x["at"])).alias("kept"))).otherwise(acc)

    held = held.withColumn("kept", F.aggregate(ranked, start, step, lambda acc: acc["kept"]))
    dropped = F.size("pieces") - 1 - F.size("kept")
    body = F.array_join(F.filter("pieces", lambda x, i: (i == 0) | F.array_contains("kept", i)), "")
    cut = held.where(dropped > 0).select("doc_id", F.concat("front", F.regexp_replace(body, r"\n\z", ""), F.lit("\n\n["), dropped.cast("string"), F.lit(" sections omitted]")).alias("cut"), dropped.alias("dropped"))
    return docs.select("doc_id", "body").join(cut, "doc_id", "left").select("doc_id", F.coalesce("cut", "body").alias("body"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


def summary_tier(ranked: DataFrame, residents: DataFrame, shown: DataFrame, predicted: DataFrame, costs: DataFrame, top: int = 2, budget: int = 400, load_floor: float = 2, apart: int = 10) -> DataFrame:
    """(prompt_id, doc_id, place, running): what is offered as a summary besides what loads.

    ranked: prompt_id, now, doc_id, score, rank, retrieved with a relaxed floor and ``top`` plus the summaries' depth; the
    first ``top`` of those with ``load_floor`` load. residents: prompt_id, doc_id. shown: prompt_id, doc_id, last (the clock
    when a document was last offered before). predicted: prompt_id, doc_id, rank; costs: doc_id, tokens. Ranked ones come
    first, then predicted ones, as a prefix under the budget.
    """
    order = F.row_number().over(W.partitionBy("prompt_id").orderBy("rank"))
    loads = ranked.where(F.col("score") >= load_floor).withColumn("place", order).where(F.col("place") <= top).select("prompt_id", "doc_id")
    clock = ranked.groupBy("prompt_id").agg(F.max("now").alias("now"))
    first = ranked.join(loads, ["prompt_id", "doc_id"], "left_anti").select("prompt_id", "doc_id", F.lit(0).alias("tier"), "rank")
    known = first.select("prompt_id", "doc_id").union(loads)
    second = predicted.join(known, ["prompt_id", "doc_id"], "left_anti").select("prompt_id", "doc_id", F.lit(1).alias("tier"), "rank")
    held = first.unionByName(second).join(residents.select("prompt_id", "doc_id"), ["prompt_id", "doc_id"], "left_anti").join(clock, "prompt_id")
    held = held.join(shown, ["prompt_id", "doc_id"], "left").where(F.col("last").isNull() | (F.col("now") - F.col("last") >= apart)).join(costs, "doc_id")
    held = held.withColumn("place", F.row_number().over(W.partitionBy("prompt_id").orderBy("tier", "rank", "doc_id")))
    return prefix_budget(held, budget, order="place").select("prompt_id", "doc_id", "place", "running")
