"""Quality rules: text statistics and a decision list learned from labelled statistics, all as Spark expressions.

Sequential covering: thresholds come from quantiles, one grouped count per step tells how a condition splits the labelled
rows, the condition with the most information gain is added until a rule is pure or three conditions long. A third of the
rows prunes each rule to its best prefix; rows that a kept rule covers leave, and the next rule is grown. A condition must
cover ``MIN_SHARE`` of the growing rows (``MIN_COVER`` at least). Learning ends with the first rule whose precision on the
pruning rows is under ``MIN_PRECISION``. The list becomes one ordered ``CASE WHEN`` expression. All labelled rows teach;
nothing is sampled.

Defined results: null and empty texts have zero in every statistic and fail the base rule; very long texts are counted
whole; repeated rows get equal results; a document labelled more than once counts with its least quality; null labels and
labels of unknown documents teach nothing; ties between conditions go to the first feature and value; without labels of
both kinds, or without rows, the list is empty and the base rule decides alone; an empty table gives no row; other columns
of docs and labels are not read, so their names do not matter.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, folder, stored

PLACE_BITS = 28

FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}
BINS, MAX_CONDITIONS = 32, 3
MIN_PRECISION, MIN_COVER, MIN_SHARE = 0.8, 5, 0.002
WHITE = " \t\n\x0b\f\r"


def _number_of(chars: str) -> Column:
    return F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, word and line counts of each whole text. docs needs doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias("w"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t\\x0B\\f\\r]")).alias("lines"),
        _number_of("#*$%&|<>").alias("n_symbols"),
        _number_of("A-Z").alias("n_upper"),
        _number_of("!?.,;:").alias("n_marks"),
    )
    counts = ["doc_id", "word_chars", "n_symbols", "n_upper", "n_marks"]
    out = out.select(*counts, "w", F.size("w").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    counts += ["n_words", "n_dup_lines"]
    place = (1 << PLACE_BITS) - 1
    # A window as one long: the upper bits of its hash, then its place. Sorting brings windows that may be equal together.
    # A text whose windows differ in those bits has no repeat; only the others are sorted.
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(F.lit(~place)))
    out = out.select(*counts, "w", F.when(F.size("w") >= 3, window).alias("p"))
    placed = F.transform("p", lambda x, i: x.bitwiseOR(i.cast("long")))
    out = out.select(*counts, "w", F.when(F.size(F.array_distinct("p")) < F.size("p"), F.sort_array(placed)).otherwise(F.array().cast("array<long>")).alias("p"))

    def upper(x: Column) -> Column:
        return F.shiftright(x, PLACE_BITS)

    alike = F.filter("p", lambda x, i: ((i > 0) & (upper(x) == upper(F.get("p", i - 1)))) | F.coalesce(upper(x) == upper(F.get("p", i + 1)), F.lit(False)))
    out = out.select(*counts, "w", F.when(F.size("p") > 1, alike).otherwise(F.array().cast("array<long>")).alias("c"))

    def spelled(x: Column) -> Column:
        i = x.bitwiseAND(F.lit(place)).cast("int")
        return F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i"))

    out = out.select(*counts, F.when((F.size("c") > 0) & (F.size("w") > 0), F.sort_array(F.transform("c", spelled))).alias("c"))
    twice = F.filter("c", lambda x, i: F.coalesce(x["g"] == F.get("c", i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("c", i + 1)["g"], F.lit(False)))
    out = out.select(*counts, F.when(F.size("c") > 1, twice).alias("c"))
    covered = F.aggregate(
        F.sort_array(F.transform("c", lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")),
        lambda acc: acc["n"],
    )
    return out.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


class Condition:
    def __init__(self, feature: str, at_least: bool, value: float):
        self.feature, self.at_least, self.value = feature, at_least, value

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.at_least else F.col(self.feature) < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:g}"


def _all(conditions: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in conditions), F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _bin(feature: str, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge <= F.col(feature)))


def _grow(rows: DataFrame, edges: dict[str, list[float]], cover: float) -> list[Condition]:
    """Add the condition of the most gain, from counts of bad and good rows by feature and quantile bin."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        cells = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), _bin(f, e).alias("bin")) for f, e in edges.items())))
        counts = rows.where(_all(rule)).select("bad", cells.alias("cell")).groupBy("cell.f", "cell.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("all")).collect()
        best: tuple[float, Condition | None, float] = (1e-9, None, 0)
        for f, e in edges.items():
            at = {r["bin"]: (r["p"], r["all"] - r["p"]) for r in counts if r["f"] == f}
            p0, n0 = (sum(x[k] for x in at.values()) for k in (0, 1))
            for j, value in enumerate(e, 1):
                p, n = (sum(x[k] for b, x in at.items() if b >= j) for k in (0, 1))
                for one, side in (((p, n), True), ((p0 - p, n0 - n), False)):
                    if one[0] >= cover and (g := _gain(*one, p0, n0)) > best[0]:
                        best = (g, Condition(f, side, value), one[1])
        if best[1] is None:
            break
        rule.append(best[1])
        if best[2] == 0:
            break
    return rule


def learn_rules(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Conjunctions that mark low quality, in order. stats as of text_statistics; labels: doc_id, quality (0 or 1)."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(labels, "doc_id").select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2).alias("prune"), (F.col("quality") == 0).cast("int").alias("bad"), *(F.expr(c).alias(f) for f, c in FEATURES.items()))
    work = folder(stats.sparkSession, "labelled")
    rows = stored(rows, "labelled", work)
    cover = max(MIN_COVER, MIN_SHARE * rows.where("not prune").count())
    share = [k / BINS for k in range(1, BINS)]
    cuts = rows.agg(*(F.percentile_approx(f, share, 10_000).alias(f) for f in FEATURES)).first().asDict()
    edges = {f: sorted(set(e)) for f, e in cuts.items() if e}
    rules: list[list[Condition]] = []
    while edges:
        rule = _grow(rows.where(~F.col("prune")), edges, cover)
        if not rule:
            break
        held = rows.where("prune").agg(*(F.coalesce(F.sum((_all(rule[:k]) & (F.col("bad") == b)).cast("long")), F.lit(0)).alias(f"n{k}_{b}") for k in range(1, len(rule) + 1) for b in (0, 1))).first()
        worth = [(held[f"n{k}_1"] - held[f"n{k}_0"]) / max(1, held[f"n{k}_1"] + held[f"n{k}_0"]) for k in range(1, len(rule) + 1)]
        k = worth.index(max(worth)) + 1
        bad, good = held[f"n{k}_1"], held[f"n{k}_0"]
        if bad < MIN_PRECISION * max(1, bad + good):
            break
        rules.append(rule[:k])
        rows = rows.where(~_all(rule[:k]))
    discard(stats.sparkSession, work)
    return rules


def decision_list(rules: list[list[Condition]]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_all(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (the one that rejects, else null) and kept."""
    stats = stored(text_statistics(docs), "statistics")
    rule = decision_list(learn_rules(stats, labels))
    out = stats.select("*", base_failed().alias("base_failed"), *(F.expr(c).alias(f) for f, c in FEATURES.items())).withColumn("rule", rule)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
