"""Text and hash functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "before", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "this", "to", "use", "when", "with", "you", "your"]
TOPICS = ["react", "typescript", "python", "testing", "review", "design", "security", "git", "api"]
SUFFIXES = "(ing|ed|es|s)$"
TOKENS_PER_UNIT = 1.28


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """1.28 for each run of letters, digits and ``_`` and each other visible character, rounded up; 0 for null or empty."""
    units = F.size(_all(_text(text), r"(?U)[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))
    return F.when(F.length(_text(text)) > 0, F.greatest(F.lit(1), F.ceil(units * F.lit(TOKENS_PER_UNIT)))).otherwise(0).cast("long")


def tokenize(text: Column) -> Column:
    """Lower-case words of two letters or more without stop words; one suffix is cut off words longer than four."""
    words = F.filter(_all(F.lower(_text(text)), r"[\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    return F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, SUFFIXES, "")).otherwise(w))


def term_set(text: Column) -> Column:
    """The different words of `tokenize`; a word that is repeated is cut once."""
    words = F.filter(F.array_distinct(_all(F.lower(_text(text)), r"[\p{L}\p{N}]+")), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, SUFFIXES, "")).otherwise(w)))


def sampler_words(text: Column) -> Column:
    """The set of lower-case units of three characters or more."""
    return F.array_distinct(F.filter(_all(F.lower(_text(text)), r"[\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 3) & ~w.startswith("_")))


def raw_terms(text: Column) -> Column:
    return F.array_distinct(_all(F.lower(_text(text)), r"[\p{L}\p{N}]+"))


def overlap(query: Column, other: Column) -> Column:
    """Share of the query's terms that the other set has; 0 for an empty query."""
    query, other = F.array_distinct(query), F.array_distinct(other)
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, other)) / F.size(query)).otherwise(F.lit(0.0))


def normalized_lines(text: Column) -> Column:
    """The set of trimmed lower-case lines without marks, at least 36 characters long."""
    lines = F.transform(F.split(_text(text), "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[`*_#>-]", ""), r"\s+", " "))
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) >= 36))


def content_hash(text: Column) -> Column:
    return F.sha2(_text(text), 256)


def stable_rank(seed: str, key: Column) -> Column:
    """A hexadecimal string whose order is the same random order everywhere."""
    return F.sha2(F.concat(F.lit(seed + "\x00"), key.cast("string")), 256)


def stable_rank48(seed: str, key: Column) -> Column:
    """The first 48 bits of the same hash as a number; order by the key too, as two keys may be equal here."""
    return F.conv(F.substring(stable_rank(seed, key), 1, 12), 16, 10).cast("long")


def synthetic_cost(key: Column, least: int = 300, most: int = 2500) -> Column:
    return F.lit(least) + F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % F.lit(most - least + 1)


def prompt_key(prompt: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(_text(prompt))), 256), 1, 32)


def session_key(provider: Column, session: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", provider, session.cast("string")), 256)


def slug(text: Column, size: int = 48, default: str = "skill") -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(_text(text)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, size), F.lit("")), F.lit(default))


def stable_id(provider: Column, name: Column, path: Column) -> Column:
    return F.concat_ws("-", provider, slug(name), F.substring(F.sha2(path, 256), 1, 10))


def document_text(name: Column, description: Column, body: Column, description_size: int = 500, body_size: int = 8000) -> Column:
    return F.concat_ws(" | ", _text(name), F.substring(_text(description), 1, description_size), F.substring(_text(body), 1, body_size))


def query_text(prompt: Column, prefix: str, size: int = 2000) -> Column:
    return F.concat(F.lit(prefix), F.substring(_text(prompt), 1, size))


def front_matter(text: Column, key: str) -> Column:
    """The value of a key of a leading ``---`` block: plain, quoted, or a folded or literal block."""
    head = F.regexp_extract(_text(text), r"\A---\r?\n([\s\S]*?)\r?\n---", 1)
    line = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1)
    block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*[>|][+-]?[ \t]*\n((?:[ \t]+.*(?:\n|\z))+)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    folded = F.when(line.startswith("|"), F.array_join(lines, "\n")).otherwise(F.array_join(lines, " "))
    value = F.when(line.rlike("^[>|][+-]?[ \t]*$"), folded).otherwise(F.regexp_replace(F.trim(line), "^([\"'])(.*)\\1$", "$2"))
    return F.nullif(value, F.lit(""))


def outline(text: Column, size: int = 8) -> Column:
    """The first headings of levels one to three after the front matter."""
    body = F.regexp_replace(_text(text), r"\A---\r?\n[\s\S]*?\r?\n---", "")
    return F.slice(F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*#{1,3}[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(1)), 1, size)


def escape_attr(text: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")), text)


def redact_body(text: Column, filler: str = "lorem") -> Column:
    """Headings stay, every other line becomes as many neutral words as it had, 4 to 40; empty lines stay."""
    def line(x: Column) -> Column:
        words = F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
        neutral = F.array_join(F.array_repeat(F.lit(filler), F.least(F.greatest(words, F.lit(4)), F.lit(40))), " ")
        return F.when(x.rlike(r"^\s*#{1,6}\s") | (F.trim(x) == ""), x).otherwise(neutral)

    return F.array_join(F.transform(F.split(_text(text), "\n"), line), "\n")


def topics(text: Column, known: list[str] = TOPICS) -> Column:
    return F.filter(F.array(*map(F.lit, known)), lambda t: F.contains(F.lower(_text(text)), t))
