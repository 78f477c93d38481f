"""From ranked documents to the context of each prompt: what loads, what is restated, what is offered as a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import stored
from . import budget

LOADED, RESTATED, OFFERED, SKIPPED = range(4)


def element(tag: str, inner: Column) -> Column:
    return F.concat(F.lit(f'<{tag} name="'), tx.escape_attr(F.coalesce("name", F.lit(""))), F.lit('" provider="'), tx.escape_attr(F.coalesce("provider", F.lit(""))), F.lit('">\n'), inner, F.lit(f"\n</{tag}>"))


def digest_text(description: Column, body: Column) -> Column:
    """A document in short: its description and a line of its first headings."""
    heads = tx.outline(body)
    return F.concat(F.coalesce(description, F.lit("")), F.when(F.size(heads) > 0, F.concat(F.lit("\nSections: "), F.array_join(heads, ", "))).otherwise(""))


def prompt_context(
    prompts: DataFrame, ranked: DataFrame, catalog: DataFrame, residents: DataFrame, shown: DataFrame, predicted: DataFrame, overlays: DataFrame,
    top: int = 2, token_budget: int = 8000, load_floor: float = 2, summary_budget: int = 400, apart: int = 10, gate: int = 2000, section_budget: int = 1200,
) -> DataFrame:
    """(prompt_id, loaded, restated, offered, skipped, tokens, context), a row for every prompt.

    prompts: prompt_id, prompt. ranked: prompt_id, now, doc_id, score, rank, with a relaxed floor and some depth below ``top``.
    catalog: doc_id, name, provider, description, body. residents: prompt_id, doc_id, stale. shown: prompt_id, doc_id, last.
    predicted: prompt_id, doc_id, rank. overlays: doc_id, overlay (notes to append).

    The first ``top`` documents over the floor are selected. Those not resident yet load under the token budget, at the cost of
    what is shown: sections are chosen by the prompt first, notes are appended then and never cut. Stale residents among the
    selected are restated in short. What was ranked or predicted besides is offered in short under its own budget.
    A null body is an empty text. ``ranked`` is read by every part of the plan: store it first if it is costly. Lists of one prompt are short, so they are gathered once, at the end.
    """
    order = F.row_number().over(W.partitionBy("prompt_id").orderBy("rank"))
    selected = ranked.where(F.col("score") >= load_floor).withColumn("place", order).where(F.col("place") <= top).select("prompt_id", "doc_id", "place")
    wanted = ranked.select("doc_id").union(predicted.select("doc_id")).distinct()
    texts = catalog.join(wanted, "doc_id", "left_semi").select("doc_id", "name", "provider", digest_text(F.col("description"), F.col("body")).alias("short"))
    texts = stored(texts.withColumn("cost", tx.estimate_tokens(F.col("short"))), "short")  # read by several parts of the plan, as are the texts that may load
    bodies = catalog.select("doc_id", "name", "provider", F.coalesce("body", F.lit("")).alias("body"))
    known = residents.groupBy("prompt_id", "doc_id").agg(F.max("stale").alias("stale"))

    held = selected.join(known, ["prompt_id", "doc_id"], "left_anti").join(prompts.select("prompt_id", "prompt"), "prompt_id").join(bodies, "doc_id")
    both = F.struct("prompt_id", "doc_id")
    trimmed = budget.select_sections(held.select(both.alias("doc_id"), "prompt", "body"), section_budget, gate).select("doc_id.prompt_id", "doc_id.doc_id", F.col("body").alias("trimmed"))
    held = held.drop("prompt", "body").join(trimmed, ["prompt_id", "doc_id"]).join(overlays.select("doc_id", "overlay"), "doc_id", "left")
    held = held.withColumn("shown", F.concat_ws("\n\n", "trimmed", "overlay")).drop("trimmed", "overlay")
    held = stored(held.withColumn("tokens", tx.estimate_tokens(F.col("shown"))).withColumn("content_hash", tx.content_hash(F.col("shown"))), "shown")
    judged = budget.greedy_budget(held.select("prompt_id", F.col("place").alias("rank"), "doc_id", "tokens", "content_hash"), token_budget)
    judged = judged.select("prompt_id", "doc_id", "reason").join(held, ["prompt_id", "doc_id"])
    kind = F.when(F.col("reason").isNull(), LOADED).otherwise(SKIPPED)
    loads = judged.select("prompt_id", kind.alias("kind"), "place", "doc_id", "reason", "tokens", F.when(F.col("reason").isNull(), element("document", F.col("shown"))).alias("rendered"))

    in_short = lambda df, kind, tag: df.join(texts, "doc_id").select("prompt_id", F.lit(kind).alias("kind"), "place", "doc_id", F.lit(None).cast("string").alias("reason"), F.lit(0).cast("long").alias("tokens"), element(tag, F.col("short")).alias("rendered"))
    restated = in_short(selected.join(known.where("stale"), ["prompt_id", "doc_id"]), RESTATED, "document-again")
    costs = texts.select("doc_id", F.col("cost").alias("tokens"))
    offered = in_short(budget.summary_tier(ranked, known, shown, predicted, costs, top, summary_budget, load_floor, apart), OFFERED, "document-available")

    parts = loads.unionByName(restated).unionByName(offered)
    lists = parts.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("kind", "place", "doc_id", "reason", "tokens", "rendered"))).alias("parts"))
    of = lambda kind, name: F.transform(F.filter("parts", lambda x: x["kind"] == kind), lambda x: x[name])
    blocks = F.filter(F.array(*(F.array_join(of(k, "rendered"), "\n") for k in (LOADED, RESTATED, OFFERED))), lambda x: x != "")
    lists = prompts.select("prompt_id").join(lists, "prompt_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast(lists.schema["parts"].dataType)))
    spent = F.aggregate(of(LOADED, "tokens"), F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.select("prompt_id", of(LOADED, "doc_id").alias("loaded"), of(RESTATED, "doc_id").alias("restated"), of(OFFERED, "doc_id").alias("offered"), of(SKIPPED, "reason").alias("skipped"), spent.alias("tokens"), F.array_join(blocks, "\n\n").alias("context"))
