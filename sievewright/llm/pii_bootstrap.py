"""Personal data: fixed formats, and identifiers discovered from their lexical contexts. DataFrame functions only.

The fixed formats (email, ip, card, phone) are the seeds, known values. Candidates are all other words with a digit or an
``@`` that overlap no seed. Patterns are lexical contexts alone, whatever the value looks like: the word before, the two
words before, the words on both sides, the two words after. The graph of patterns and values is scored in turns. Of a
pattern's different values some are known or accepted by then, some look like a fixed format but fail its check (negatives),
the others are unknown: its confidence is known / (known + negatives + ``UNKNOWN`` * unknown), and it counts from
``MIN_SUPPORT`` known values and a confidence of ``MIN_SCORE`` on. A value's score is 1 if it is known, else the confidence
of its best pattern that counts. After ``ROUNDS`` turns, accepted values are spans of kind ``context`` wherever they stand,
if one pattern that counts holds ``MIN_SHARE`` of the value's occurrences and under its shape (a weak check) ``MIN_SHAPE`` of
the different candidates were accepted.

Matches get their offsets without Python: a match is framed by two marks that no pattern can match, the text is split at
the marks, and the lengths of the parts add up. Marks in the text itself are first replaced by another control character.
What is stored on the way has offsets, shapes and digests of values and patterns, no text, and is removed.

Words of a context are read from up to ``AROUND`` characters on either side; of a longer word those nearest count.

Defined results: null counts as empty; an empty text has no span; very long texts are handled whole; repeated rows get equal
spans and ties do not matter: counts are of different values; a text is one row of the result, with or without a doc_id; an
empty table gives no row; other columns of docs are not read, so their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import discard, folder, lookup, stored

ROUNDS, MIN_SCORE, MIN_SUPPORT, UNKNOWN, MIN_SHARE, MIN_SHAPE = 2, 0.8, 5, 0.25, 0.5, 0.05
AROUND = 200  # characters of context
BLOCK = 256  # even, so that a block begins outside a match
KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<start:int,end:int,value:string,left:string,right:string>>"

# Each starts where a match of the plain pattern starts first; possessive, as nothing that follows could need less.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _none() -> Column:
    return F.array().cast(SPANS)


def _parts(pattern: str) -> Column:
    """Column ``t`` cut at its matches: text between matches and matches in turn."""
    return F.split(F.regexp_replace("t", F.lit(f"({pattern})"), F.lit("\x01$1\x02")), "[\x01\x02]")


def _blocks(parts: str) -> Column:
    """Spans of blocks of ``BLOCK`` parts, offsets from the block's head: short lists, so that appending stays cheap in long texts.

    left, right: the text around a match, up to ``AROUND`` characters, whatever block or match it is in.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = (acc["at"] + F.length(part)).cast("int")
        one = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def framed(s: Column, place: Column) -> Column:
        """place: of the match among the parts, from 1. Six parts hold the next two words and more."""
        first = F.greatest(F.lit(1), place - 6)
        before = F.array_join(F.transform(F.slice(parts, first, place - first), lambda x: F.right(x, F.lit(AROUND))), "")
        after = F.array_join(F.transform(F.slice(parts, place + 1, F.lit(6)), lambda x: F.left(x, F.lit(AROUND))), "")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.right(before, F.lit(AROUND)).alias("left"), F.left(after, F.lit(AROUND)).alias("right"))

    def block(b: Column) -> Column:
        held = F.aggregate(F.slice(parts, b * BLOCK + 1, BLOCK), start, step)
        return F.struct(held["at"].alias("at"), F.transform(held["out"], lambda s, i: framed(s, (b * BLOCK + i * 2 + 2).cast("int"))).alias("out"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    return F.when(F.size(parts) > 1, F.transform(numbers, block))


def _spans(blocks: str, test) -> Column:
    """All spans of a text that pass the test."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("heads"))
    heads = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + b["at"]).cast("int").alias("at"), F.concat(acc["heads"], F.array(acc["at"])).alias("heads")), lambda acc: acc["heads"])
    moved = F.zip_with(blocks, heads, lambda b, h: F.transform(b["out"], lambda s: F.struct((s["start"] + h).alias("start"), (s["end"] + h).alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"))))
    return F.coalesce(F.when(F.size(blocks) > 0, F.filter(F.flatten(moved), test)), _none())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _card(s: Column) -> Column:
    digits = _digits(s["value"])
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)


def fixed_formats(docs: DataFrame) -> DataFrame:
    """row, doc_id, spans of each kind, and candidates. docs needs doc_id and text."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), "\x01\x02", "\x03\x03")
    docs = docs.select("doc_id", F.when(F.coalesce(F.col("text"), F.lit("")).rlike("[\x01\x02]"), text).otherwise(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    t = F.col("t")
    digit = t.rlike("[0-9]")
    wanted = {
        "email": (t.contains("@"), EMAIL, lambda s: F.lit(True)),
        "ip": (t.rlike(IP), IP, lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": (t.rlike(CARD), CARD, _card),
        "phone": (t.contains("+"), PHONE, lambda s: F.length(_digits(s["value"])).between(8, 15)),
        "candidates": (digit | t.contains("@"), CANDIDATE, lambda s: F.lit(True)),
    }
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(F.when(some, _parts(pattern)).alias(k) for k, (some, pattern, _) in wanted.items()))
    docs = docs.select("row", "doc_id", *(_blocks(k).alias(k) for k in wanted))
    return docs.select("row", "doc_id", *(_spans(k, test).alias(k) for k, (_, _, test) in wanted.items()))


def _shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "a")


def _patterns(left: Column, right: Column) -> Column:
    """Digests of the contexts of a value; a context that lacks a word is left out."""
    told = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    before, after = told(left), told(right)
    l1, l2 = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2))
    r1, r2 = F.get(after, 0), F.get(after, 1)
    each = F.array(F.concat(l1, F.lit(" _")), F.concat(l2, F.lit(" "), l1, F.lit(" _")), F.concat(l1, F.lit(" _ "), r1), F.concat(F.lit("_ "), r1, F.lit(" "), r2))
    return F.transform(F.array_compact(each), F.md5)


def _described(found: DataFrame) -> DataFrame:
    """Spans by kind without their text, and seeds and candidates with digests and patterns; closing marks do not belong to a candidate."""
    marks = r"[\p{Punct}&&[^@]]+$"

    def seed(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.md5(s["value"]).alias("name"), F.lit("").alias("shape"), F.lit(False).alias("negative"), _patterns(s["left"], s["right"]).alias("patterns"))

    def candidate(s: Column) -> Column:
        closing, value = F.regexp_extract(s["value"], marks, 0), F.regexp_replace(s["value"], marks, "")
        negative = value.rlike(rf"^(?:{IP}|{CARD})$")
        return F.struct(s["start"].alias("start"), (s["end"] - F.length(closing)).cast("int").alias("end"), F.md5(value).alias("name"), _shape(value).alias("shape"), negative.alias("negative"), _patterns(s["left"], F.concat(closing, s["right"])).alias("patterns"))

    kinds = (F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS)
    return found.select("row", "doc_id", *kinds, F.transform(F.concat(*KINDS), seed).alias("seeds"), F.transform("candidates", candidate).alias("candidates"))


def _candidates(described: DataFrame) -> DataFrame:
    """row, start, end, name, shape, negative, known, patterns, of the seeds and of the candidates that overlap no seed."""
    known = described.select("row", F.explode("seeds").alias("c")).select("row", "c.*", F.lit(True).alias("known"), F.col("c.start").alias("at"))
    other = described.select("row", F.explode("candidates").alias("c")).select("row", "c.*", F.lit(False).alias("known"), F.col("c.end").alias("at"))
    # a candidate comes after all seeds that begin before its end: the furthest end of those tells whether one reaches it
    until_here = W.partitionBy("row").orderBy("at", "known").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(F.col("known"), F.col("end"))).over(until_here)
    both = known.unionByName(other).withColumn("reach", reach)
    return both.where(F.col("known") | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).where("end > start").drop("at", "reach")


def discovered(candidates: DataFrame, within: str) -> DataFrame:
    """(name) of the values that context alone shows to be identifiers."""
    edges = candidates.select("name", "known", "negative", F.explode("patterns").alias("pattern")).groupBy("pattern", "name").agg(F.max("known").alias("seed"), F.max("negative").alias("negative"), F.count("*").alias("n"))
    edges = stored(edges, "edges", within)
    enough = edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= MIN_SUPPORT)  # others can never count
    edges = stored(lookup(edges, "pattern", enough, within).where("values is not null").drop("values"), "pattern-graph", within)
    accepted = edges.where("seed").select("name").distinct().withColumn("accepted", F.lit(True))
    for _ in range(ROUNDS):
        held = lookup(edges, "name", accepted, within)
        is_known = F.coalesce("accepted", F.lit(False))
        counts = held.groupBy("pattern").agg(F.sum(is_known.cast("long")).alias("support"), F.sum((~is_known & F.col("negative")).cast("long")).alias("against"), F.count("*").alias("values"))
        unknown = F.col("values") - F.col("support") - F.col("against")
        sure = counts.where(F.col("support") >= MIN_SUPPORT).where(F.col("support") >= MIN_SCORE * (F.col("support") + F.col("against") + UNKNOWN * unknown))
        sure = stored(sure.select("pattern", F.lit(True).alias("sure")), "sure-patterns", within)
        hit = stored(lookup(edges, "pattern", sure, within).where("sure").select("name", "seed", "negative", "n"), "hits", within)
        accepted = stored(hit.where("seed or not negative").select("name").union(edges.where("seed").select("name")).distinct().withColumn("accepted", F.lit(True)), "accepted", within)
    often = hit.where("not seed and not negative").groupBy("name").agg(F.max("n").alias("n"))
    other = candidates.where(~F.col("known")).groupBy("name").agg(F.first("shape").alias("shape"), F.count("*").alias("all"))
    new = other.join(often, "name", "left").select("name", "shape", F.coalesce(F.col("n") >= MIN_SHARE * F.col("all"), F.lit(False)).alias("accepted"))
    fits = new.groupBy("shape").agg(F.avg(F.col("accepted").cast("double")).alias("share")).where((F.col("share") > 0) & (F.col("share") >= MIN_SHAPE))
    return stored(lookup(new.where("accepted"), "shape", fits, within).where("share is not null").select("name", F.lit(True).alias("new")), "discovered", within)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    spark = docs.sparkSession
    work = folder(spark, "personal-data")
    described = stored(_described(fixed_formats(docs)), "described", work)
    candidates = stored(_candidates(described), "candidates", work)
    new = lookup(candidates.where(~F.col("known")).select("row", "start", "end", "name"), "name", discovered(candidates, work), work).where("new")
    new = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("more"))
    out = described.drop("seeds", "candidates").join(new, "row", "left")

    def told(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    base = F.concat(*(told(k, k) for k in KINDS))
    out = out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, told("context", "more")), ",").alias("spans"))
    out = stored(out, "personal-data")
    discard(spark, work)
    return out
