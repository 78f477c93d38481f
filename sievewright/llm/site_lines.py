"""Line dedup by site-relative frequency.

For every host: the number of different pages, and for every line (trimmed) the number of different pages that hold it.
A line on more than ``MAX_SHARE`` of a host's pages is boilerplate there and is dropped, if it stands on ``MIN_PAGES`` or
more. The default of two says only that a line of a single page is not repeated: without it every line of a host of up to
nine pages would be above the share. Equal copies of a page count as one page, so a copied page does not turn its own lines
into boilerplate.

Only hashes of lines are shuffled (two of 64 bits), counted before and after the shuffle; texts stay where they are. The
boilerplate of a host is a short list (a page's lines / MAX_SHARE at most), joined to the pages by host: broadcast if the
checked number of all such lines is at most ``BROADCAST_LINES``, else by (host, salt).

Defined results: a null source is a host of its own; null text stays null, empty text stays empty; lines without a word are
never dropped; a page of which only boilerplate had words has an empty text and ``all_boilerplate``; very long texts are
handled whole; repeated rows (ties) get equal results; all rows stay; an empty table gives no row; any further column is
kept, whatever its name, but for ``n_dropped`` and ``all_boilerplate``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import packed, stored

MAX_SHARE, MIN_PAGES = 0.1, 2
BROADCAST_LINES, SALTS = 200_000, 64
WORD = "[^ \\t\\n\\x0B\\f\\r]"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def _name(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _host() -> Column:
    return F.coalesce(F.col("source"), F.lit("\x00")).alias("line_host")


def boilerplate(docs: DataFrame, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(line_host, lines): the names of the lines to drop."""
    pages = docs.where("text is not null").select(_host(), F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(3), "text").alias("b")).alias("page"), F.col("text").alias("line_text"))
    totals = pages.select("line_host", "page").distinct().groupBy("line_host").agg(F.count("*").alias("pages"))
    lines = pages.select("line_host", "page", F.explode(F.array_distinct(F.transform(F.filter(F.transform(F.split("line_text", "\n"), _trimmed), lambda x: x != ""), _name))).alias("line"))
    counts = lines.distinct().groupBy("line_host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals, "line_host").where(F.col("n") > F.lit(max_share) * F.col("pages"))
    return often.groupBy("line_host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with text without boilerplate lines, ``n_dropped`` and ``all_boilerplate``. docs needs text and source."""
    known = stored(boilerplate(docs, max_share, min_pages), "boilerplate")
    held = docs.select(packed(docs, "n_dropped", "all_boilerplate"), F.col("text").alias("line_text"), _host())
    if (known.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES:
        held = held.join(F.broadcast(known), "line_host", "left")
    else:
        salted = known.withColumn("line_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("line_salt", F.pmod(F.xxhash64("line_text"), F.lit(SALTS))).join(salted, ["line_host", "line_salt"], "left")
    kept = F.filter(F.split("line_text", "\n"), lambda line: ~F.array_contains("lines", _name(_trimmed(line))))
    held = held.select("row", F.when(F.col("lines").isNotNull() & F.col("line_text").isNotNull(), kept).alias("line_kept"), F.size(F.split("line_text", "\n")).alias("line_count"))
    held = held.select("row", F.array_join("line_kept", "\n").alias("line_text"), F.when(F.col("line_kept").isNotNull(), F.col("line_count") - F.size("line_kept")).otherwise(0).cast("long").alias("line_dropped"))
    empty = (F.col("line_dropped") > 0) & ~F.col("line_text").rlike(WORD)
    out = F.when(empty, "").when(F.col("line_dropped") > 0, F.col("line_text")).otherwise(F.col("row.text"))
    names = held.schema["row"].dataType.names
    return held.select(*(out.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in names), F.col("line_dropped").alias("n_dropped"), F.coalesce(empty, F.lit(False)).alias("all_boilerplate"))
