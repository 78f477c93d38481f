"""URL filters: host and path rules, then a block list held as a sorted array of 64-bit digests.

The block list is a table of entries, each a host or a host with a path prefix that ends at a ``/``. Its xxhash64 digests
are sorted and kept beside the full strings. A url is probed by all its host suffixes, alone and with all path prefixes, up to the
length of the longest entry: one vectorised binary search for a batch of urls, and equal digests are confirmed on the stored strings.

A list of up to ``ARRAY_ENTRIES`` entries and ``ARRAY_CHARS`` characters (both checked) is one array, broadcast to all
tasks. A longer list is cut by a hash of the entry into shards of about half that size; each shard is packed into an array
in a task, and the probes of all different sites meet the array of their shard, at most about ``PROBES`` at a time. Either
way each Python worker writes an array to an unlinked file of its temporary folder and maps it; nothing is read from there
by anyone else.

Defined results: host and path of a null or empty url, or of one without ``://``, are empty: no rule fits and the verdict is
allow; very long urls are probed with all their prefixes that are no longer than the longest entry; repeated rows get equal verdicts; of rules that fit, the longest
wins (ties: the last in order); null and empty entries and an empty list block nothing; an empty table gives no row; other
columns of pages are not read, so their names do not matter.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, folder, stored

ARRAY_ENTRIES, ARRAY_CHARS, PROBES, SALTS, BATCH_CHARS = 2_000_000, 64_000_000, 2_000_000, 16, 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def probes(host: str, path: str, longest: int) -> list[str]:
    """What of a url a block list may hold whose longest entry has ``longest`` characters: nothing longer is built, however long the url is."""
    hosts, at = [], len(host)
    while host and at >= 0:
        at = host.rfind(".", 0, at)
        if len(host) - at - 1 > longest:
            break
        hosts.append(host[at + 1 :])
    cuts, at = [], path.find("/", 1, longest) if path[:1] == "/" else -1
    while at >= 0:
        cuts.append(at + 1)
        at = path.find("/", at + 1, longest)
    if 1 < len(path) <= longest:
        cuts.append(len(path))
    return [*hosts, *(h + path[:i] for h in hosts for i in dict.fromkeys(cuts) if len(h) + i <= longest)]


class DigestArray:
    """Sorted digests with their strings, in a memory map."""

    def __init__(self, entries: list[str]):
        held = sorted((xxhash.xxh64_intdigest(e.encode()), e.encode()) for e in set(entries))
        self.count = len(held)
        ends = np.cumsum([0, *(len(e) for _, e in held)], dtype=np.int64)
        self.packed = np.array([d for d, _ in held], np.uint64).tobytes() + ends.tobytes() + b"".join(e for _, e in held)
        self._map = None

    @classmethod
    def of(cls, count: int, packed: bytes) -> DigestArray:
        self = cls([])
        self.count, self.packed = count, packed
        return self

    def __getstate__(self) -> dict:
        return {"count": self.count, "packed": self.packed, "_map": None}

    def _parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._map is None:
            with tempfile.TemporaryFile() as file:  # has no name: it is gone with the map
                file.write(self.packed)
                file.flush()
                self._map = np.memmap(file, np.uint8, "r")
            self.packed = b""
        n = self.count
        return self._map[: 8 * n].view(np.uint64), self._map[8 * n : 16 * n + 8].view(np.int64), self._map[16 * n + 8 :]

    def holds(self, strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), bool)
        if not self.count or not strings:
            return out
        digests, ends, text = self._parts()
        keys = np.array([xxhash.xxh64_intdigest(s.encode()) for s in strings], np.uint64)
        low, high = np.searchsorted(digests, keys, "left"), np.searchsorted(digests, keys, "right")
        for i in np.flatnonzero(high > low):
            out[i] = any(text[ends[j] : ends[j + 1]].tobytes() == strings[i].encode() for j in range(low[i], high[i]))
        return out


def _mark(array, longest: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [probes(h, p, longest) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            found = array.value.holds([x for held in lists for x in held])
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            yield pa.record_batch([*batch.columns, pa.array(np.bincount(owner[found], minlength=len(lists)) > 0)], [*batch.schema.names, "listed"])

    return run


def _probed(longest: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, str]] = []
        size = 0
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for each in probes(host, path, longest):
                    held.append((host, path, each))
                    size += len(host) + len(path) + len(each)
                    if size > BATCH_CHARS:
                        yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*held, strict=True)], ["host", "path", "probe"])
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*held, strict=True)], ["host", "path", "probe"])

    return run


def _pack(entries: pa.Table) -> pa.Table:
    array = DigestArray(entries.column("entry").to_pylist())
    return pa.table({"shard": entries.column("shard")[:1].cast(pa.int32()), "count": pa.array([array.count], pa.int64()), "packed": pa.array([array.packed], pa.binary())})


def _meet(asked: pa.Table, shard: pa.Table) -> pa.Table:
    found = np.zeros(asked.num_rows, bool)
    if asked.num_rows and shard.num_rows:
        found = DigestArray.of(shard.column("count")[0].as_py(), shard.column("packed")[0].as_py()).holds(asked.column("probe").to_pylist())
    return asked.select(["host", "path"]).filter(pa.array(found))


def _sharded(pages: DataFrame, entries: DataFrame, shards: int, longest: int) -> DataFrame:
    """The same for lists of any length: the sites' probes meet the arrays shard by shard."""
    spark = pages.sparkSession
    work = folder(spark, "url-filter")
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int").alias("shard")
    arrays = stored(entries.select("entry").distinct().select(shard("entry"), "entry").groupBy("shard").applyInArrow(_pack, "shard int, count long, packed binary"), "arrays", work)
    sites = pages.select("host", "path").distinct()
    asked = stored(sites.mapInArrow(_probed(longest), "host string, path string, probe string").select(shard("probe"), "host", "path", "probe"), "probes", work)
    sizes = asked.groupBy("shard").count().select("shard", F.ceil(F.col("count") / PROBES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("host", "path", "probe"), F.col("parts")).cast("int").alias("part")
    asked = asked.join(F.broadcast(sizes), "shard").select("shard", part, "host", "path", "probe")
    arrays = arrays.join(F.broadcast(sizes), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "count", "packed")
    hit = asked.groupBy("shard", "part").cogroup(arrays.groupBy("shard", "part")).applyInArrow(_meet, "host string, path string").distinct()
    listed = stored(hit, "listed-sites")
    discard(spark, work)
    hit = listed.select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("found"))
    # one site may hold a third of all pages: its rows are dealt over the salts
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(hit, ["host", "path", "salt"], "left")
    return salted.select("page_id", "host", "path", F.coalesce("found", F.lit(False)).alias("listed"))


def filter_urls(pages: DataFrame, entries: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, listed, verdict). pages needs page_id and url; entries: entry."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    entries = entries.where("entry is not null and entry <> ''")
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.length("entry")), F.lit(0)).alias("longest")).first()
    if size["n"] <= ARRAY_ENTRIES and size["chars"] <= ARRAY_CHARS:
        array = pages.sparkSession.sparkContext.broadcast(DigestArray([r[0] for r in entries.select("entry").collect()]))
        listed = pages.mapInArrow(_mark(array, size["longest"]), "page_id long, host string, path string, listed boolean")
    else:
        listed = _sharded(pages, entries, math.ceil(2 * max(size["n"] / ARRAY_ENTRIES, size["chars"] / ARRAY_CHARS)), size["longest"])
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    return listed.select("page_id", "host", "path", name.alias("rule"), "listed", F.coalesce(says, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
