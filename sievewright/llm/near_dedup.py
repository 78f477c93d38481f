"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Document frequencies. One scan counts, over all documents, how many hold each of ``2**18`` hash buckets of five-word
   shingles; a second counts exactly the shingles of those buckets that ``COMMON`` of all documents or more hold. A shingle
   that itself is in that share of the documents weighs ``1 + ln(N / df) / ln(1 / COMMON)``, all rarer ones weigh 2: weights
   depend on relative frequency alone and are the same at every size. There are at most (shingles a document) / ``COMMON``
   common ones, and they are broadcast.
2. A further scan draws ``BANDS * ROWS`` consistent weighted samples of each document. Texts that are equal after case
   folding and removal of punctuation become one node; only nodes go on, so groups of copies never multiply.
3. Nodes that share a band meet in blocks of about ``BLOCK`` nodes and ``BLOCK_BYTES`` of vectors at most. Inside a block
   every pair of different classes is verified by weighted Jaccard similarity and only a spanning forest of links leaves it.
   A larger bucket is dealt to several blocks; afterwards its nodes outside the largest class meet, block by block, all
   others whose total weight allows the similarity, so no pair of a bucket that could join two classes stays unseen.
4. Connected components of the links are found with joins and aggregates. Texts are not shuffled: a scan turns those that
   are needed into vectors of 32-bit elements, and these meet the blocks.

Keys that hold many rows (a class, a text with many copies, a node with many links) are joined apart from the others.

Defined results: a null or empty text, or one without any word, is alone in its class unless an equal non-empty text
exists; a null doc_id has class null; repeated rows share a class; texts under five words count as one shingle; very long
texts are compared whole; ties: a class has the least doc_id; an empty table gives no row; other columns of docs are not
read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import discard, folder, lookup, packed, stored

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, FIRST_BANDS = 14, 4, 4
DF_BITS, TABLE_BITS, COMMON = 18, 15, 0.01
UNIT = 16  # weights are whole sixteenths, so that their sums are exact
BLOCK, BLOCK_BYTES = 256, 16 << 20
BROADCAST_IDS, HELD_COUNTS = 1_000_000, 1_000_000


def _bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(words.BITS - DF_BITS)).astype(np.int64)


def _shingled(texts: pa.Array) -> Iterator[tuple]:
    for first, last, data, offsets in words.slices(texts):
        start, end, text = words.split(data, offsets, words.PUNCTUATED)
        value, of, _ = words.shingles(words.hashes(data, start, end), text, SHINGLE)
        yield first, last, data, offsets, *words.counted(value, of)


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << DF_BITS, np.int64)
    rows = 0
    for batch in batches:
        rows += batch.num_rows
        for *_, shingle, _, before in _shingled(batch.column(0)):
            held += np.bincount(_bucket(shingle[before == 0]), minlength=1 << DF_BITS)
    some = np.flatnonzero(held)
    yield pa.record_batch([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(held[some], rows), pa.int64())], ["bucket", "n"])


def _count_common(heavy) -> callable:
    """Exact counts of the shingles of heavy buckets; what a task holds is bounded, as it hands on partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        told = lambda: pa.record_batch([pa.array(names.astype(np.int64)), pa.array(counts)], ["shingle", "n"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            one, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            both, place = np.unique(np.concatenate([names, one]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            for *_, shingle, _, before in _shingled(batch.column(0)):
                shingle = shingle[before == 0]
                waiting.append(shingle[heavy.value[_bucket(shingle)]])
                size += len(waiting[-1])
                if size > HELD_COUNTS:
                    names, counts = merged()
                    waiting, size = [], 0
                    if len(names) > HELD_COUNTS:
                        yield told()
                        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names, counts = merged()
        yield told()

    return run


class Weights:
    """Weights of shingles in sixteenths: common ones by lookup, all others 2."""

    RARE = 2 * UNIT

    def __init__(self, heavy: np.ndarray, names: np.ndarray, df: np.ndarray, n_docs: int):
        order = np.argsort(names)
        self.heavy, self.names = heavy, names[order]
        share = np.minimum(1, df[order] / max(1, n_docs))
        self.of_names = np.round(UNIT * (1 + np.minimum(1, np.log(1 / share) / np.log(1 / COMMON)))).astype(np.uint8)

    def of(self, shingle: np.ndarray) -> np.ndarray:
        out = np.full(len(shingle), self.RARE, np.uint8)
        some = np.flatnonzero(self.heavy[_bucket(shingle)])
        if len(some) and len(self.names):
            at = np.minimum(np.searchsorted(self.names, shingle[some]), len(self.names) - 1)
            hit = self.names[at] == shingle[some]
            out[some[hit]] = self.of_names[at[hit]]
        return out


def shingle_weights(docs: DataFrame) -> Weights:
    """docs needs text. The driver gets ``2**18`` counts, then the common shingles."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_count_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n_docs = int(counts.n[counts.bucket == -1].sum())
    least = max(2, COMMON * n_docs)
    heavy = np.zeros(1 << DF_BITS, bool)
    heavy[counts.bucket[(counts.bucket >= 0) & (counts.n >= least)].to_numpy()] = True
    if not heavy.any():
        return Weights(heavy, np.zeros(0, np.uint64), np.zeros(0), n_docs)
    held = spark.sparkContext.broadcast(heavy)
    common = docs.select("text").mapInArrow(_count_common(held), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    held.destroy()
    return Weights(heavy, common.shingle.to_numpy(np.int64).astype(np.uint64), common.n.to_numpy(np.float64), n_docs)


def _element(shingle: np.ndarray, before: np.ndarray) -> np.ndarray:
    return words.mix(shingle + (before.astype(np.uint64) << np.uint64(words.BITS)))


class _Sampler:
    """``BANDS * ROWS`` samples: ln a = ln c - r * (t + 1 - beta) with t = floor(ln w / r + beta), the least of a text is its sample.

    An element draws c by one part of its hash, r and beta by another: two elements get the same numbers once in 2**30
    pairs, so texts of any length are told apart.
    """

    def __init__(self):
        n, size = BANDS * ROWS, 1 << TABLE_BITS
        rng = np.random.default_rng(20240229)
        self.r = rng.standard_gamma(2.0, (n, size), np.float32)
        self.beta = rng.random((n, size), np.float32)
        self.c = rng.standard_gamma(2.0, (n, size), np.float32)
        np.log(self.c, out=self.c)
        self.odd = rng.integers(1, 1 << 62, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        most = np.float32(np.log(2.0))
        self.usual = np.empty((n, size), np.float32)
        for k in range(n):  # row by row: no further table of this size is held
            self.usual[k] = self.r[k] * (np.floor(most / self.r[k] + self.beta[k]) + 1 - self.beta[k])

    def bands(self, element: np.ndarray, weight: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """A row of band keys for each text; the text's elements begin at ``heads``."""
        common = np.flatnonzero(weight != Weights.RARE)
        ln = np.log(weight[common] / np.float32(UNIT), dtype=np.float32)
        keys = np.zeros((len(heads), BANDS), np.uint64)
        for k in range(BANDS * ROWS):
            place = (element * self.odd[k]) >> np.uint64(64 - 2 * TABLE_BITS)
            i, j = (place >> np.uint64(TABLE_BITS)).astype(np.int64), (place & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
            a = self.c[k][j] - self.usual[k][i]
            if len(common):
                r, beta = self.r[k][i[common]], self.beta[k][i[common]]
                a[common] = self.c[k][j[common]] - r * (np.floor(ln / r + beta) + 1 - beta)
            least = np.minimum.reduceat(a, heads).view(np.uint32).astype(np.uint64)
            band = k // ROWS
            keys[:, band] = words.mix(keys[:, band] * np.uint64(31) + least + np.uint64(band + 1))
        return keys


def _names(element: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Where each text's elements begin, and 128 bits that name the text by its words."""
    if not len(text):
        return np.zeros(0, np.int64), []
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    folded = words.mix(element * np.uint64(0x9E3779B97F4A7C15))
    one, two = np.add.reduceat(folded, heads), np.add.reduceat(words.mix(folded), heads)
    return heads, [a.tobytes() + b.tobytes() for a, b in zip(one, two, strict=True)]


def _sketch(weights) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = None
        for batch in batches:
            sampler = sampler or _Sampler()  # one for each task; it is not kept in idle workers
            for first, last, data, offsets, shingle, text, before in _shingled(batch.column(1)):
                n = last - first
                nodes, keys = [None] * n, [None] * n
                size, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                element = _element(shingle, before)
                heads, names = _names(element, text)
                if names:
                    weight = weights.value.of(shingle)
                    found = sampler.bands(element, weight, heads).view(np.int64)
                    for i, t in enumerate(text[heads]):
                        nodes[t] = names[i]
                        keys[t] = found[i]
                    size[text[heads]] = np.diff(np.append(heads, len(text)))
                    total[text[heads]] = np.add.reduceat(weight, heads, dtype=np.int64)
                for i in range(n):
                    if nodes[i] is None and offsets[i + 1] > offsets[i]:  # no word: equal texts still meet
                        nodes[i] = hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
                yield pa.record_batch([batch.column(0)[first:last], pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(size), pa.array(total)], ["doc_id", "node", "bands", "elements", "weight"])

    return run


def _vectors(weights) -> callable:
    """doc_id, node and vector: the number of rare elements, all elements in 32 bits, rare ones first, and a byte of weight for each common one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, _, shingle, text, before in _shingled(batch.column(1)):
                element = _element(shingle, before)
                heads, names = _names(element, text)
                short, weight = (element >> np.uint64(32)).astype(np.uint32), weights.value.of(shingle)
                held = []
                for a, b in zip(heads, np.append(heads[1:], len(text)), strict=True):
                    rare = weight[a:b] == Weights.RARE
                    held.append(np.uint32(rare.sum()).tobytes() + short[a:b][rare].tobytes() + short[a:b][~rare].tobytes() + weight[a:b][~rare].tobytes())
                rows = batch.column(0).take(pa.array(first + text[heads], pa.int64()))
                yield pa.record_batch([rows, pa.array(names, pa.binary()), pa.array(held, pa.binary())], ["doc_id", "node", "vector"])

    return run


def _unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    rare = int(np.frombuffer(vector, np.uint32, 1)[0])
    n = (len(vector) - 4 + rare) // 5
    weight = np.full(n, Weights.RARE, np.float32)
    weight[rare:] = np.frombuffer(vector, np.uint8, n - rare, 4 + 4 * n)
    return np.frombuffer(vector, np.uint32, n, 4), weight


def _forest(block: pd.DataFrame) -> pd.DataFrame:
    """Verify the pairs of a block that would join two groups; return links from the least of the joined groups to the others."""
    block = block.drop_duplicates("node").sort_values("node").reset_index(drop=True)
    held = [_unpacked(v) for v in block.vector]
    names, place = np.unique(np.concatenate([e for e, _ in held]), return_inverse=True)
    place = place.astype(np.int32)
    each = np.concatenate([w for _, w in held])
    size = [len(e) for e, _ in held]
    heads = np.cumsum([0, *size[:-1]])
    total = np.add.reduceat(each, heads, dtype=np.float64)
    group = pd.factorize(block["group"])[0]
    mark = np.zeros(len(names), bool)
    for i in range(len(block)):
        other = (group != group[i]) & (np.minimum(total, total[i]) >= THRESHOLD * np.maximum(total, total[i]))
        if not other.any():
            continue
        mine = place[heads[i] : heads[i] + size[i]]
        mark[mine] = True
        shared = np.add.reduceat(each * mark[place], heads, dtype=np.float64)
        mark[mine] = False
        for j in np.flatnonzero(other & (shared >= THRESHOLD * (total + total[i] - shared) - 1e-9)):
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
    least: dict[int, bytes] = {}
    for g, name in zip(group.tolist(), block["group"], strict=True):
        least[g] = min(name, least.get(g, name))
    out = {(least[g], name) for g, name in zip(group.tolist(), block["group"], strict=True) if least[g] != name}
    return pd.DataFrame(sorted(out), columns=["a", "b"])


def components(links: DataFrame, within: str | None = None) -> DataFrame:
    """(node, group) for the nodes of the links; the group is the least node of the connected component.

    Each round takes the least label among neighbours and then follows labels to their own label, so that long chains
    halve. Labels are written to the shared folder every round; nodes with many links, and labels with many nodes, are
    joined apart.
    """
    within = within or folder(links.sparkSession, "components")
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links", within)
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("group")), "labels", within)
    while True:
        near = lookup(both, "b", label.select(F.col("node").alias("b"), "group"), within).groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("group").alias("old"), F.least("group", "near").alias("new"))
        up = label.select(F.col("node").alias("new"), F.col("group").alias("higher"))
        step = stored(lookup(step, "new", up, within).select("node", "old", F.least("new", "higher").alias("group")), "labels", within)
        label = step.select("node", "group")
        if step.where("group <> old").isEmpty():
            return label


def _joined(groups: DataFrame | None, links: DataFrame, within: str) -> DataFrame:
    """(node, group) after links between groups; only the links' own graph is walked, whatever was joined before."""
    if groups is None:
        return components(links, within)
    if links.isEmpty():
        return groups
    upper = components(links, within).select(F.col("node").alias("group"), F.col("group").alias("higher"))
    known = lookup(groups, "group", upper, within).select("node", F.coalesce("higher", "group").alias("group"))
    fresh = upper.join(groups.select(F.col("group")).distinct(), "group", "left_anti").select(F.col("group").alias("node"), F.col("higher").alias("group"))
    return stored(known.union(fresh), "groups", within)


def _grouped(nodes: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return nodes.withColumn("group", F.col("node"))
    return nodes.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))


def _blocks(rows, elements):
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(elements * 4 / BLOCK_BYTES)).cast("int")


def _links(blocks: DataFrame, vectors: DataFrame, within: str) -> DataFrame:
    """Links between groups. blocks: (key, node, group), at most a few hundred rows a key."""
    return stored(blocks.join(vectors, "node").groupBy("key").applyInPandas(_forest, "a binary, b binary"), "found", within)


def _rest_of_large_buckets(member: DataFrame, groups: DataFrame, within: str) -> DataFrame | None:
    """Blocks in which what lies outside the largest class of a large bucket meets the bucket's other nodes of a like weight."""
    held = stored(_grouped(member.where("blocks > 1"), groups), "large", within)
    count = held.groupBy("key", "group").agg(F.count("*").alias("n"))
    main = count.groupBy("key").agg(F.max(F.struct("n", "group"))["group"].alias("main"), F.count("*").alias("groups")).where("groups > 1")
    held = held.join(main, "key").withColumn("bin", F.floor(F.log("weight") / -np.log(THRESHOLD)))  # similar nodes are in one bin or two neighbours
    inside = held.select("key", "bin", "node", "group", "elements", F.lit(False).alias("outside"))
    outside = held.where(F.col("group") != F.col("main")).select("key", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "node", "group", "elements", F.lit(True).alias("outside"))
    both = stored(inside.union(outside), "sides", within)
    side = lambda s: (F.sum(F.when(F.col("outside") == s, 1).otherwise(0)), F.sum(F.when(F.col("outside") == s, F.col("elements")).otherwise(0)))
    sizes = both.groupBy("key", "bin").agg(*(c.alias(n) for s, k in ((False, "in"), (True, "out")) for c, n in zip(side(s), (f"{k}_rows", f"{k}_elements"), strict=True)))
    sizes = sizes.where("in_rows > 0 and out_rows > 0").select("key", "bin", _blocks(F.col("in_rows"), F.col("in_elements")).alias("blocks"), _blocks(F.col("out_rows"), F.col("out_elements")).alias("parts"))
    if sizes.isEmpty():
        return None
    both = both.join(sizes, ["key", "bin"])
    dealt = lambda n, salt: F.array(F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    both = both.select("key", "bin", "node", "group", "parts", "outside", F.explode(F.when(F.col("outside"), every("blocks")).otherwise(dealt("blocks", "block"))).alias("block"))
    both = both.select("key", "bin", "node", "group", "block", F.explode(F.when(F.col("outside"), dealt("parts", "part")).otherwise(every("parts"))).alias("part"))
    return both.select(F.concat_ws("/", "key", "bin", "block", "part").alias("key"), "node", "group")


def _node_vectors(docs: DataFrame, wanted: DataFrame, weights, within: str) -> DataFrame:
    """(node, vector) of the wanted nodes (node, rep). Texts stay where they are; beyond ``BROADCAST_IDS`` nodes all vectors are made and met by doc_id."""
    schema = "doc_id long, node binary, vector binary"
    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    if reps.count() <= BROADCAST_IDS:
        made = docs.join(F.broadcast(reps), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_vectors(weights), schema)
    else:
        made = docs.mapInArrow(_vectors(weights), schema).join(wanted.select("node", F.col("rep").alias("doc_id")), ["doc_id", "node"], "left_semi")
    return stored(made.select("node", "vector"), "vectors", within)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size): class_id is the least doc_id of the class. docs needs doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    work = folder(spark, "near-dedup")
    weights = spark.sparkContext.broadcast(shingle_weights(docs))
    sketch = stored(docs.mapInArrow(_sketch(weights), "doc_id long, node binary, bands array<long>, elements long, weight long"), "sketch", work)
    nodes = sketch.where("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("elements").alias("elements"), F.first("weight").alias("weight"))
    nodes = stored(nodes, "nodes", work)
    member = nodes.select("node", "elements", "weight", F.posexplode("bands").alias("band", "key")).withColumn("band", F.col("band").cast("byte"))
    sizes = member.groupBy("key").agg(F.count("*").alias("size"), F.sum("elements").alias("all_elements")).where("size > 1").select("key", _blocks(F.col("size"), F.col("all_elements")).alias("blocks"))
    member = stored(member.join(sizes, "key"), "members", work)
    vectors = _node_vectors(docs, nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", "rep"), weights, work)
    groups = None
    for bands in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        # a bucket of one class needs no more work
        held = _grouped(member.where(bands), groups)
        mixed = held.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("key")
        held = held.join(mixed, "key").withColumn("key", F.concat_ws("/", "key", F.pmod(F.xxhash64("node", "band"), F.col("blocks"))))
        groups = _joined(groups, _links(held.select("key", "node", "group"), vectors, work), work)
    if not member.where("blocks > 1").isEmpty():
        rest = _rest_of_large_buckets(member, groups, work)
        if rest is not None:
            groups = _joined(groups, _links(rest, vectors, work), work)
    held = stored(_grouped(nodes.select("node", "rep", "copies"), groups), "groups-of-nodes", work)
    classes = held.groupBy("group").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    by_node = stored(lookup(held.select("node", "group"), "group", classes, work).select("node", "class_id", "class_size"), "classes-of-nodes", work)
    out = lookup(sketch.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "node", by_node, work)
    out = stored(out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")), "classes")
    discard(spark, work)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each class the one with the least doc_id; rows without a doc_id stay.

    Rows that share a doc_id are one document: the first by content stays. Up to ``BROADCAST_IDS`` dropped documents are
    broadcast, so that no text is shuffled; more are joined.
    """
    classes = near_duplicate_classes(docs).where("doc_id is not null")
    held = classes.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("class_id")).alias("keep"))
    drop = held.where(~F.col("keep")).select("doc_id")
    few = drop.count() <= BROADCAST_IDS
    kept = docs.where("doc_id is not null").select("doc_id", packed(docs)).join(F.broadcast(drop) if few else drop, "doc_id", "left_anti")
    again = held.where("keep and rows > 1").select("doc_id")
    if not again.isEmpty():
        first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(again, "doc_id", "left_anti").unionByName(first)
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
