"""Readers and writers: JSON lines, nested relevance, document trees, manifests, traces, versioned tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, sessions
from .shared import discard, folder

SKIPPED = "/(\\.git|node_modules|vendor|dist|build)/"
POOL = "skill_id string, id string, name string, description string, desc string, body string, skill_md string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All ``*.jsonl`` and ``*.jsonl.gz`` below a folder; blank lines give no row."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").json(path)
    return df.dropna("all")


def pool(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, description, body), whichever of the two names a column has."""
    df = json_lines(spark, path, POOL)
    return df.select(F.coalesce("skill_id", "id").alias("doc_id"), "name", F.coalesce("description", "desc").alias("description"), F.coalesce("body", "skill_md").alias("body"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    df = json_lines(spark, path, "query_id string, skill_id string, relevance double")
    return df.where("relevance > 0").select(F.col("query_id").alias("task_id"), F.col("skill_id").alias("doc_id"), "relevance")


def nested_relevance(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object by task to (task_id, task_type, doc_id, relevance); ids without a grade have grade 1."""
    entry = "struct<task_type:string,core_gt_ids:array<string>,gt_skill_ids:array<string>,relevance:map<string,double>>"
    held = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("task_id", "r"))
    gold = F.array_union(F.coalesce("r.core_gt_ids", F.array().cast("array<string>")), F.coalesce("r.gt_skill_ids", F.array().cast("array<string>")))
    graded = F.coalesce("r.relevance", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    held = held.select("task_id", F.col("r.task_type").alias("task_type"), graded.alias("g"), F.array_union(gold, F.map_keys(graded)).alias("ids"))
    return held.select("task_id", "task_type", "g", F.explode("ids").alias("doc_id")).select("task_id", "task_type", "doc_id", F.coalesce(F.try_element_at("g", F.col("doc_id")), F.lit(1.0)).alias("relevance"))


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of Spark's own file system, so that it holds for any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def split_path(spark: SparkSession, root: str, kind: str, split: str) -> str:
    for at in (f"{root}/data/{kind}/{split}", f"{root}/{kind}/{split}"):
        for end in (".jsonl", ".jsonl.gz"):
            if exists(spark, at + end):
                return at + end
    raise FileNotFoundError(f"no {split} of {kind} in {root}")


def normalize_dataset(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, pool, qrels) of either layout: relevance by task in one JSON object, or flat query and qrels files."""
    if exists(spark, f"{root}/relevance.json"):
        tasks = json_lines(spark, f"{root}/tasks.jsonl", "task_id string, instruction_text string").select("task_id", F.col("instruction_text").alias("text"))
        return tasks, pool(spark, f"{root}/pool"), nested_relevance(spark, f"{root}/relevance.json").select("task_id", "doc_id", "relevance")
    asked = json_lines(spark, split_path(spark, root, "queries", split), "id string, query string").select(F.col("id").alias("task_id"), F.col("query").alias("text"))
    return asked, pool(spark, f"{root}/pool"), qrels(spark, split_path(spark, root, "qrels", split))


def document_tree(spark: SparkSession, root: str, depth: int = 8) -> DataFrame:
    """(path, name, description, body) of the Markdown entries up to ``depth`` folders below a folder; the folder's name stands in for a missing one."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    files = files.where(F.col("path").rlike(r"/(SKILL\.md|instructions\.md|commands/[^/]+\.md)$") & ~F.col("path").rlike(SKIPPED))
    above = len([x for x in re.sub("^[a-z]+:/*", "", root).split("/") if x])
    below = F.size(F.filter(F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/"), lambda x: x != "")) - above
    files = files.where(below - 1 <= depth)
    return files.select("path", F.coalesce(tx.front_matter(F.col("body"), "name"), F.element_at(F.split("path", "/"), -2)).alias("name"), F.coalesce(tx.front_matter(F.col("body"), "description"), F.lit("")).alias("description"), "body")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, invalid) of JSON manifests; what cannot be parsed stays as an invalid row."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    held = files.withColumn("m", F.from_json("value", "name string, version string, _corrupt_record string", {"mode": "PERMISSIVE"}))
    return held.select("path", F.coalesce("m.name", F.element_at(F.split("path", "/"), -3)).alias("name"), F.col("m._corrupt_record").isNotNull().alias("invalid"))


def publish(df: DataFrame, root: str, version: str) -> str:
    """A new version of a table; readers take a version that is complete (Spark's commit writes _SUCCESS last)."""
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    return f"{root}/version={version}"


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that was completed last, whatever its name; versions without _SUCCESS are not seen."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()]
    done = [n for n in names if n.startswith("version=") and exists(spark, f"{root}/{n}/_SUCCESS")]
    if not done:
        raise FileNotFoundError(f"no complete version in {root}")
    when = lambda n: files.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")).getModificationTime()
    natural = lambda n: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", n)]
    return spark.read.parquet(f"{root}/{max(done, key=lambda n: (when(n), natural(n)))}")


def _shard(vectors: DataFrame, root: str, fingerprint: str, part: str) -> None:
    """One commit: all of a shard is there or nothing; the same part again takes its place."""
    vectors.write.mode("overwrite").parquet(f"{root}/fingerprint={fingerprint}/part={part}")


def append_shards(vectors: DataFrame, root: str, fingerprint: str, key: str = "doc_id") -> None:
    """Append vectors that are not stored yet under this run's fingerprint, as one shard."""
    spark = vectors.sparkSession
    if exists(spark, root):
        vectors = unfinished(vectors, spark.read.parquet(root), fingerprint, key)
    _shard(vectors, root, fingerprint, uuid.uuid4().hex)


def encode_shards(items: DataFrame, encode: Callable[[DataFrame], DataFrame], root: str, fingerprint: str, key: str = "doc_id", every: int = 100_000) -> int:
    """Encode the items without a stored vector, about ``every`` a shard, each shard one commit; the number of shards written.

    If the encoder fails, the shards before stay, and the next call encodes only what is left. encode: adds ``embedding`` to rows.
    Vectors of a shard whose size is not the one stored under this fingerprint are an error. Items of a null key are left out.
    """
    spark = items.sparkSession
    items = items.where(F.col(key).isNotNull())
    size = None
    if exists(spark, f"{root}/fingerprint={fingerprint}"):
        held = spark.read.parquet(root)
        items = unfinished(items, held, fingerprint, key)
        size = held.where(F.col("fingerprint") == fingerprint).agg(F.max(F.size("embedding"))).first()[0]
    shards = -(-items.count() // every)
    if not shards:
        return 0
    work, run = folder(spark, "shards"), uuid.uuid4().hex
    items.withColumn("shard_of_run", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).write.partitionBy("shard_of_run").parquet(work)
    pending = spark.read.schema(items.withColumn("shard_of_run", F.lit(0)).schema).parquet(work)
    for k in range(shards):
        wanted = F.lit(size) if size is not None else F.size("embedding")
        odd = F.raise_error(F.concat(F.lit("a vector of another size: "), F.size("embedding").cast("string")))
        vectors = encode(pending.where(F.col("shard_of_run") == k).drop("shard_of_run"))
        _shard(vectors.withColumn("embedding", F.when(F.size("embedding") == wanted, F.col("embedding")).otherwise(odd)), root, fingerprint, f"{run}-{k}")
        if size is None:
            sizes = spark.read.parquet(root).where(F.col("fingerprint") == fingerprint).agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
            if sizes.low != sizes.high:
                raise ValueError(f"vectors of sizes {sizes.low} to {sizes.high} in one shard")
            size = sizes.high
    discard(spark, work)
    return shards


def shard_stream(items: DataFrame, encode: Callable[[DataFrame], DataFrame], root: str, fingerprint: str, checkpoint: str):
    """The same for a stream: a micro-batch is a shard; a batch that is run again takes its own place, so no row is stored twice."""

    def one(batch: DataFrame, n: int) -> None:
        _shard(encode(batch), root, fingerprint, f"batch-{n}")

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shard_progress(stored: DataFrame, total: DataFrame, fingerprint: str) -> DataFrame:
    """(records, total, dimensions): how far a run is."""
    mine = stored.where(F.col("fingerprint") == fingerprint)
    return mine.agg(F.count("*").alias("records"), F.max(F.size("embedding")).alias("dimensions")).join(total.agg(F.count("*").alias("total")), F.lit(True))


def append_trace(trace: DataFrame, path: str, checkpoint: str):
    """Append-only sink of a stream; ends when all available input is written."""
    return trace.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_daily_trace(trace: DataFrame, path: str, checkpoint: str, at: str = "ts"):
    """The same, one folder for each day of the events, so that ``tail`` reads the last days only; events without a time go to a folder of their own."""
    return trace.withColumn("day", F.to_date(at)).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tail(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The last events (ts, event_id, ...) of a daily trace in ascending order: days are taken backwards until they hold enough.

    Older days are not opened. Days are counted one by one from the file footers; events without a time are not in the tail.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.isDirectory()]
    days = sorted((n.removeprefix("day=") for n in names if re.fullmatch(r"day=\d{4,}-\d\d-\d\d", n)), reverse=True)
    if not days:
        raise FileNotFoundError(f"no days in {path}")
    schema = spark.read.parquet(f"{path}/day={days[0]}").schema
    trace = spark.read.schema(schema.add("day", "date")).parquet(path)
    held, first = 0, days[0]
    for first in days:
        held += trace.where(F.col("day") == F.lit(first).cast("date")).count()
        if held >= limit:
            break
    return sessions.trace_tail(trace.where(F.col("day") >= F.lit(first).cast("date")).drop("day"), limit)


def tree_fingerprint(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A SHA-256 of the files below a folder: every file's path below it, length and SHA-256 are a row of ``catalog.fingerprint``.

    A changed byte, a new name or place of a file and a missing file each change it; the order of listing does not. A file is
    one row while it is hashed and so must be under 2 GB.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    above = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return catalog.fingerprint(files.select(F.substring("path", len(above) + 2, 1 << 30).alias("path"), "length", F.sha2("content", 256).alias("digest")))


def write_report(report: DataFrame, root: str, benchmark: str, partition: str) -> None:
    """One partition for each benchmark and partition; a new report replaces only its own."""
    held = report.withColumn("benchmark", tx.slug(F.lit(benchmark))).withColumn("partition", tx.slug(F.lit(partition)))
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("benchmark", "partition").parquet(root)


def route_stream(prompts: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run a batch plan on every micro-batch of prompts; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, n: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return prompts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def predict_stream(selected: DataFrame, rules_root: str, path: str, checkpoint: str, limit: int = 2):
    """What goes with the items (key, item) of a stream by the association rules that were published last, read anew for each micro-batch."""
    return route_stream(selected, lambda batch: sessions.predict_next(batch.select("key", "item"), published(batch.sparkSession, rules_root), limit), path, checkpoint)


def unfinished(tasks: DataFrame, done: DataFrame, run_fingerprint: str, key: str = "task_id") -> DataFrame:
    """Tasks without a result of this run's fingerprint."""
    return tasks.join(done.where(F.col("fingerprint") == run_fingerprint).select(key), key, "left_anti")
