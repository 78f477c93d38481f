"""From raw documents to a training mix: five stages, each a job over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever their names; an empty table stays empty, repeated
rows are repeated documents, very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import decontaminate, language_spans, mixing, near_dedup, site_lines
from sievewright.llm.scratch import discard, folder, stored, table

MIN_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts and texts without a letter go, and those of which no language has half of the letters. Rows without a doc_id or lang may teach, and are judged, like others."""
    held_out = F.coalesce(language_spans.held_out(F.col("doc_id")), F.lit(False))
    labelled = language_spans.label_languages(docs, docs.where(~held_out))
    return labelled.where((F.col("lang_pred") != language_spans.NO_LANGUAGE) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text. All rows stay; a page of boilerplate only has an empty text; a null source is a site of its own."""
    out = site_lines.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id; null, empty and wordless texts stay, and so do rows without a doc_id."""
    return near_dedup.one_of_each(docs).select(docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go; null and empty texts and items match nothing."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet the target weights of their sources; ``copy`` counts from 1. A null source is one source, rows without a doc_id draw by their content."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]

#: SQL cannot express the stages 1, 3 and 4; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is removed when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        own = folder(spark, name.replace(" ", "-"))
        docs = stored(stage(spark, docs, sf_dir), "documents", own)
        if before:
            discard(spark, before)
        before = own
    return docs
