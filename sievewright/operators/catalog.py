"""Catalog tables: profiles, deduplication, eligibility, references and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

DESCRIPTION_SIZE = 320
NAME_SIZE = 64
MIRROR_PENALTY = 1_000_000
# Folders that hold copies.
MIRRORS = [".agents", ".cursor", ".factory", ".gbrain", ".hermes", ".kiro", ".openclaw", ".opencode", ".slate"]


def from_documents(docs: DataFrame) -> DataFrame:
    """doc_id, provider, name, description, body and token counts; a name is the first two terms of the description."""
    description = F.substring(F.coalesce("text", F.lit("")), 1, DESCRIPTION_SIZE)
    held = docs.select("doc_id", F.col("lang").alias("provider"), "source", description.alias("description"), F.col("text").alias("body"))
    first = F.array(tx.tokenize(F.substring("description", 1, NAME_SIZE)))  # of three terms the first two are whole; only if there are fewer all is cut
    two = F.transform(first, lambda t: F.when(F.size(t) > 2, F.slice(t, 1, 2)).otherwise(F.slice(tx.tokenize(F.col("description")), 1, 2)))
    held = held.withColumn("name", F.array_join(F.get(two, F.lit(0)), "-"))
    return held.select("*", tx.estimate_tokens(F.concat_ws(" ", "name", "description")).alias("activation_tokens"), tx.estimate_tokens(F.col("body")).alias("full_tokens"))


def eligible(catalog: DataFrame, provider: str) -> DataFrame:
    return catalog if provider == "all" else catalog.where(F.col("provider").isin(provider, "all"))


def is_mirror(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, MIRRORS)))


def rejection_reason(path: Column) -> Column:
    """Why a file is not a catalog entry; null if it is one."""
    return (
        F.when(~path.rlike(r"\.(md|html)$"), "unsupported-kind")
        .when(path.rlike("(^|/)\\.system/"), "system-path")
        .when(path.rlike("/plugins/cache/"), "plugin-cache")
        .when(path.rlike("(^|/)\\.state/"), "own-state")
    )


def catalog_profile(catalog: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row: entries and tokens of all files, and of those that stay after deduplication (``loaded``)."""
    total = lambda df, c: df.agg(F.count("*").alias(c), F.coalesce(F.sum("activation_tokens"), F.lit(0)).cast("long").alias(f"{c}_catalog_tokens"), F.coalesce(F.sum("full_tokens"), F.lit(0)).cast("long").alias(f"{c}_full_tokens"))
    return total(catalog, "files").join(total(loaded, "entries"), F.lit(True))


def provider_profile(catalog: DataFrame, providers: list[str], rest: str = "other") -> DataFrame:
    """Counts and tokens of each provider of a fixed list, also of those without rows; all others, null too, are one group ``rest``."""
    fixed = catalog.sparkSession.createDataFrame([(p,) for p in [*providers, rest]], "provider string")
    named = F.when(F.col("provider").isin(providers), F.col("provider")).otherwise(rest).alias("provider")
    largest = F.max(F.struct("full_tokens", (-F.col("doc_id")).alias("order")))
    sums = catalog.groupBy(named).agg(F.count("*").alias("n"), F.sum("activation_tokens").alias("catalog_tokens"), F.sum("full_tokens").alias("full_tokens"), largest.alias("top"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "catalog_tokens", "full_tokens")]
    return F.broadcast(fixed).join(sums, "provider", "left").select("provider", *zero, (-F.col("top.order")).alias("largest_doc"), F.col("top.full_tokens").alias("largest_tokens"))


def line_counts(catalog: DataFrame) -> DataFrame:
    """(line_hash, tokens, n) of all normalized lines; only hashes and token counts are shuffled."""
    lines = catalog.select(F.explode(tx.normalized_lines(F.col("body"))).alias("line"))
    return lines.select(F.sha2("line", 256).alias("line_hash"), tx.estimate_tokens(F.col("line")).alias("tokens")).groupBy("line_hash").agg(F.max("tokens").alias("tokens"), F.count("*").alias("n"))


def repeated_line_tokens(catalog: DataFrame) -> DataFrame:
    held = line_counts(catalog).where("n > 1")
    return held.agg(F.count("*").alias("repeated_lines"), F.coalesce(F.sum(F.col("tokens") * (F.col("n") - 1)), F.lit(0)).cast("long").alias("duplicate_tokens"))


def repeated_tokens_by_document(catalog: DataFrame) -> DataFrame:
    lines = catalog.select("doc_id", F.explode(tx.normalized_lines(F.col("body"))).alias("line")).select("doc_id", F.sha2("line", 256).alias("line_hash"))
    hit = lines.join(line_counts(catalog).where("n > 1"), "line_hash").groupBy("doc_id").agg(F.sum("tokens").alias("repeated_tokens"))
    return catalog.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("repeated_tokens", F.lit(0)).cast("long").alias("repeated_tokens"))


def best_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order. min_by keeps one row a key before the shuffle, so hot keys are cheap."""
    names = df.columns
    held = df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("best"))
    return held.select("best.*")


def logical_dedup(entries: DataFrame, *ties: str) -> DataFrame:
    """entries: provider, name, path, ...; the shortest path outside mirror folders stays, then the first path, then the least of ``ties``."""
    rank = F.when(is_mirror(F.col("path")), MIRROR_PENALTY).otherwise(0) + F.length("path")
    return best_of(entries, ["provider", "name"], [rank, F.col("path"), *map(F.col, ties)])


def name_dedup(entries: DataFrame) -> DataFrame:
    """The best of each (provider, name) and every other entry outside mirror folders; ``reason`` is null for those kept."""
    rank = F.when(is_mirror(F.col("path")), MIRROR_PENALTY).otherwise(0) + F.length("path")
    best = logical_dedup(entries).select("provider", "name", F.col("path").alias("best_path"))
    held = entries.withColumn("rank", rank).join(best, ["provider", "name"])
    return held.withColumn("reason", F.when((F.col("path") != F.col("best_path")) & is_mirror(F.col("path")), "mirror-of-kept-entry")).drop("rank", "best_path")


def content_dedup(entries: DataFrame, key: str = "body", order: str = "doc_id") -> DataFrame:
    """(content_hash, kept, copies): the least id for each text."""
    return entries.groupBy(tx.content_hash(F.col(key)).alias("content_hash")).agg(F.min(order).alias("kept"), F.count("*").alias("copies"))


def resolve_references(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """references: ref. A reference is an id or a name; the id wins, then the first entry in index order."""
    by_id = references.join(catalog.select(F.col("doc_id").cast("string").alias("ref"), "doc_id"), "ref").select("ref", F.lit(0).alias("kind"), "doc_id")
    first = catalog.groupBy(F.col("name").alias("ref")).agg(F.min("doc_id").alias("doc_id"))
    by_name = references.join(first, "ref").select("ref", F.lit(1).alias("kind"), "doc_id")
    found = by_id.unionByName(by_name).groupBy("ref").agg(F.min(F.struct("kind", "doc_id")).alias("m"))
    return references.distinct().join(found, "ref", "left").select("ref", F.when(F.col("m.kind") == 0, "id").when(F.col("m.kind") == 1, "name").otherwise("unknown").alias("matched_by"), F.col("m.doc_id").alias("doc_id"))


def outermost_paths(paths: DataFrame) -> DataFrame:
    """paths: path. Those without an ancestor in the set, found by equality with the proper prefixes."""
    paths = paths.distinct()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = paths.where(F.size(parts) > 1).select("path", F.explode(prefixes).alias("ancestor"))
    inner = above.join(paths.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("path").distinct()
    return paths.join(inner, "path", "left_anti")


def longest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files: path; roots: root. The longest root that holds each file."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    held = files.select("path", F.explode(prefixes).alias("root")).join(roots.distinct(), "root")
    return held.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def topic_overlap(catalog: DataFrame, known: list[str] = tx.TOPICS) -> DataFrame:
    held = catalog.select(F.explode(tx.topics(F.concat_ws(" ", "name", "description"), known)).alias("topic"))
    return held.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 2")


def case_violations(cases: DataFrame, catalog: DataFrame, top: int = 2) -> DataFrame:
    """cases: case_id, prompt, expected, forbidden. One row for each broken rule; empty if all is well."""
    say = lambda rule: F.lit(rule).alias("rule")
    empty = cases.where(F.trim(F.coalesce("prompt", F.lit(""))) == "").select("case_id", say("empty-prompt"))
    key = F.lower(F.trim("prompt")).alias("key")
    again = cases.groupBy(key).agg(F.count("*").alias("n"), F.min("case_id").alias("first")).where("n > 1")
    twice = cases.select("case_id", key).join(again, "key").where("case_id <> first").select("case_id", say("repeated-prompt"))
    long = cases.where(F.size("expected") > top).select("case_id", say("too-many-expected"))
    both = cases.where(F.arrays_overlap("expected", "forbidden")).select("case_id", say("expected-and-forbidden"))
    named = cases.select("case_id", F.explode(F.array_union("expected", "forbidden")).alias("doc_id"))
    unknown = named.join(catalog.select("doc_id"), "doc_id", "left_anti").select("case_id", say("unknown-id")).distinct()
    return empty.unionByName(twice).unionByName(long).unionByName(both).unionByName(unknown)


def suite_violations(skills: DataFrame, sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(subject, rule), one row for each broken rule of a session suite; empty if all is well.

    skills: name, description; sessions: session; turns: session, position, prompt, names (array of what a turn refers to).
    """
    say = lambda df, subject, rule: df.select(subject.cast("string").alias("subject"), F.lit(rule).alias("rule"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    place = F.concat_ws("/", "session", "position")
    out = say(skills.where(blank(F.col("name")) | blank(F.col("description"))), F.coalesce("name", F.lit("")), "skill-without-text")
    out = out.union(say(skills.groupBy("name").count().where("count > 1"), F.col("name"), "repeated-skill"))
    out = out.union(say(sessions.where("session is null"), F.lit(""), "session-without-id")).union(say(sessions.groupBy("session").count().where("count > 1"), F.col("session"), "repeated-session"))
    out = out.union(say(sessions.where("session is not null").distinct().join(turns.select("session").distinct(), "session", "left_anti"), F.col("session"), "session-without-turns"))
    out = out.union(say(turns.where(blank(F.col("prompt"))), place, "turn-without-prompt"))
    named = turns.select(place.alias("place"), F.explode("names").alias("name")).distinct()
    return out.union(say(named.join(skills.select("name").distinct(), "name", "left_anti").select("place").distinct(), F.col("place"), "unknown-reference"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A SHA-256 of a table that does not depend on row order.

    Every row has a SHA-256 of its columns as text; its eight 32-bit lanes are summed over all rows, as they come, and the
    sums and the number of rows are hashed. Nothing is gathered, whatever the number of rows.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns))
    row = df.select(F.sha2(text, 256).alias("h"))
    lanes = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(10,0)").alias(f"l{i}") for i in range(8)]
    sums = row.select(*lanes).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"l{i}"), F.lit(0)).alias(f"s{i}") for i in range(8)))
    return sums.select(F.sha2(F.concat_ws(",", *(F.col(f"s{i}").cast("string") for i in range(8)), F.col("n").cast("string")), 256).alias("fingerprint"))
