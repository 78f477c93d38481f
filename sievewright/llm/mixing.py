"""Mixing sources to target weights by Poisson replication.

A source with n of N documents and target share t gets the mean repetition rate t * N / n. Each document's uniform number
comes from a hash of seed and doc_id; the inverse of the Poisson distribution turns it into a count, the document is
emitted that often, and one shuffle by a hash of (seed, doc_id, copy) with a sort inside the partitions orders all globally
at random. The result depends on seed and rows only, not on partitions.

The rates are one small row for each source. They are broadcast when their checked size allows; otherwise documents and
rates meet on (source, salt), so that a source with a third of all rows is dealt over ``SALTS`` parts.

Defined results: a null source is a source of its own; null, empty and very long texts are kept as they are; rows with one
doc_id (repeated rows, ties) get equal counts; a row without a doc_id draws by a hash of all its columns; an empty table
gives no row; any further column is kept, whatever its name, but for ``copy``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import packed, stored

SEED = "mix-1"
TEMPERATURE = 0.5
BROADCAST_STEPS, SALTS = 500_000, 64


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit("\x00")).alias("mix_source")


def repetition_rates(docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(mix_source, rate, cdf). targets: source, weight; a source without a weight is dropped. Default weight: size ** temperature."""
    sizes = docs.groupBy(_source()).agg(F.count("*").alias("n"))
    if targets is None:
        sizes = sizes.withColumn("weight", F.pow("n", F.lit(temperature)))
    else:
        own = targets.groupBy(_source()).agg(F.sum("weight").alias("weight"))
        sizes = sizes.join(own, "mix_source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sizes = stored(sizes, "sizes")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    rate = F.lit(float(total["n"] or 0)) * F.col("weight") / F.lit(float(total["weight"] or 1.0)) / F.col("n")
    rates = sizes.where("weight > 0").select("mix_source", rate.alias("rate"))
    # Up to where 1 - CDF is below the steps of the uniform number; in logarithms, so that large rates do not underflow.
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    cdf = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-F.col("rate")).alias("ln"), F.array(F.exp(-F.col("rate"))).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["ln"] + F.log(F.col("rate") / k)).alias("ln"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["ln"] + F.log(F.col("rate") / k)))).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )
    return stored(rates.select("mix_source", "rate", cdf.alias("cdf")), "rates")


def uniform(name: Column) -> Column:
    """52 bits of a SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: DataFrame | None = None, seed: str = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """The columns of docs and ``copy`` (from 1), in global random order. docs needs doc_id and source."""
    rates = repetition_rates(docs, targets, temperature)
    row = packed(docs, "copy")
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.sha2(F.to_json(row), 256))))
    held = docs.select(row, _source(), name.alias("mix_name")).withColumn("mix_u", uniform(F.col("mix_name")))
    steps = rates.agg(F.sum(F.size("cdf"))).first()[0] or 0
    if steps <= BROADCAST_STEPS:
        held = held.join(F.broadcast(rates), "mix_source")
    else:
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.withColumn("mix_salt", F.pmod(F.xxhash64("mix_name"), F.lit(SALTS))).join(salted, ["mix_source", "mix_salt"])
    count = F.size(F.filter("cdf", lambda c: c <= F.col("mix_u")))
    held = held.select("row", "mix_name", count.alias("mix_count")).where("mix_count > 0")
    held = held.select("row", "mix_name", F.explode(F.sequence(F.lit(1), F.col("mix_count"))).alias("copy"))
    held = held.withColumn("mix_key", F.xxhash64("mix_name", "copy"))
    return held.repartition("mix_key").sortWithinPartitions("mix_key", "mix_name", "copy").select("row.*", "copy")
