"""Hard-negative mining by slots: rows of another label that score just under a positive.

An anchor's positives are its best rows of the same label. For each of them the negatives wanted are the best within
``LOW`` to ``HIGH`` hundredths of its score, so an anchor asks for several windows that overlap. The upper ends of its windows
cut the scores into disjoint slots. A task keeps the best rows of each slot only (`Slots`, the combiner), what tasks kept is
merged by slot, and a window's answer is the beginning of the merged slots from its own downwards, cut at its lower end: as the
slots fall in score, a suffix of them is a sorted list.

Anchors are a stated query set: they are taken in blocks of ``BLOCK`` that are broadcast (their size is that bound), two scans
of the rows each, and a block's result is written before the next begins. No pair of rows is emitted that is not among the
best of a slot of a task, and a label or vector that many rows share adds nothing to what is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .centroid_clusters import finite, whole
from .scratch import folder

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
BLOCK, CELLS, HELD = 8192, 2_000_000, 400_000
#: Integers of components end here, so that scores of up to 16,384 components stay within 64 bits.
LARGEST = 1 << 24
NONE = -(1 << 62)


class Slots:
    """The best ``top`` rows of each slot of each anchor: score falling, then id rising; equal (score, id) count once.

    upper: a row for each anchor, its slots' upper ends falling (``NONE``: no slot); scores under ``lower`` never count.
    """

    def __init__(self, upper: np.ndarray, lower: np.ndarray, top: int):
        self.upper, self.lower, self.top = upper, lower.astype(np.int64).copy(), top
        self.last = np.maximum((upper != NONE).sum(1) - 1, 0)
        self._kept: list[tuple[np.ndarray, ...]] = []
        self._size, self._next = 0, 0

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """scores: a row for each of these anchors, a column for each id."""
        wanted = (scores >= self.lower[anchors][:, None]) & (scores <= self.upper[anchors, 0][:, None])
        row, at = np.nonzero(wanted if allowed is None else wanted & allowed)
        score, own = scores[row, at].astype(np.int64), anchors[row]
        self._kept.append((own, (self.upper[own] >= score[:, None]).sum(1) - 1, score, ids[at]))
        self._size += len(row)
        if self._size > self._next:
            self._next = len(self.rows()[0]) + HELD

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, slot, score, id) of the best so far; all else is forgotten."""
        if not self._kept:
            return (np.zeros(0, np.int64),) * 4
        anchor, slot, score, ids = (np.concatenate(x) for x in zip(*self._kept, strict=True))
        order = np.lexsort((ids, -score, slot, anchor))
        anchor, slot, score, ids = anchor[order], slot[order], score[order], ids[order]
        begins = np.ones(len(order), bool)
        begins[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
        new = begins.copy()
        new[1:] |= (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        anchor, slot, score, ids, begins = anchor[new], slot[new], score[new], ids[new], begins[new]
        heads = np.flatnonzero(begins)
        place = np.arange(len(ids)) - np.repeat(heads, np.diff(np.append(heads, len(ids))))
        full = (place == self.top - 1) & (slot == self.last[anchor])
        self.lower[anchor[full]] = np.maximum(self.lower[anchor[full]], score[full])  # the lowest slot needs nothing below
        keep = place < self.top
        self._kept, self._size = [(anchor[keep], slot[keep], score[keep], ids[keep])], int(keep.sum())
        return self._kept[0]


class _Block:
    """Anchors of a block by the length of their vectors."""

    def __init__(self, rows: list):
        self.ids, self.labels = np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int64)
        lengths = np.array([len(r.v) for r in rows])
        self.of_length = {int(n): (at, np.array([rows[i].v for i in at], np.int64).reshape(len(at), n)) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: in doubles as long as no sum can leave their 53 bits."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return a.astype(np.float64) @ b.astype(np.float64).T if bound < 1 << 53 else a @ b.T


def _best(held, upper: np.ndarray | None, lower: np.ndarray | None, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Without slots: a task's best of the same label for each anchor, its own id left out; with slots: of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = held.value
        n = len(block.ids)
        kept = Slots(np.full((n, 1), -NONE) if upper is None else upper, np.full(n, NONE + 1) if lower is None else lower, top)
        for batch in batches:
            ids, labels = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:2])
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, head = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            for length, (anchors, matrix) in block.of_length.items():
                mine = np.flatnonzero(lengths == length)
                if upper is None:
                    parts = [(np.flatnonzero(block.labels[anchors] == x), mine[labels[mine] == x]) for x in np.intersect1d(block.labels[anchors], labels[mine])]
                else:
                    parts = [(np.arange(len(anchors)), mine)]
                for asked, rows in parts:
                    first, step = 0, 64  # a small part first: it tells how high a score must be
                    while first < len(rows):
                        part = rows[first : first + step]
                        first, step = first + step, max(64, CELLS // len(asked))
                        scores = _products(matrix[asked], flat[head[part][:, None] + np.arange(length)].reshape(len(part), length))
                        own = anchors[asked]
                        kept.add(own, scores, ids[part], block.ids[own][:, None] != ids[part] if upper is None else block.labels[own][:, None] != labels[part])
        yield pa.record_batch([pa.array(x.astype(np.int64)) for x in kept.rows()], ["anchor", "slot", "score", "id"])

    return run


_FOUND = "anchor long, slot long, score long, id long"


def _merged(found: DataFrame, top: int) -> DataFrame:
    """What tasks kept, merged: the best ``top`` of each slot, all slots of an anchor in one sorted list (score falling, id rising)."""
    place = F.dense_rank().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    best = found.repartition("anchor").withColumn("place", place).where(F.col("place") <= top)
    return best.groupBy("anchor").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("under"), "id", "slot"))).alias("best"))


def _windows(positives: list[list[tuple[int, int]]], low: int, high: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Slots' upper ends and the least lower end of each anchor; for each positive its slot and its window's lower end."""
    upper, lower, own = np.full((len(positives), max(1, *map(len, positives))), NONE), np.full(len(positives), -NONE), []
    for i, held in enumerate(positives):
        ends = [(high * score // 100, -(-low * score // 100)) for _, score in held]
        uppers = sorted({b for b, a in ends if a <= b}, reverse=True)
        upper[i, : len(uppers)] = uppers
        lower[i] = min((a for b, a in ends if a <= b), default=-NONE)
        own.append([(uppers.index(b), a) if a <= b else (-1, a) for b, a in ends])
    return upper, lower, own


def mine(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """rows (vec_id, label, embedding) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``. Rows with a null vec_id, label or vector or with a null, NaN or
    infinite component take no part; rows of another vector length than an anchor's do not meet it. Repeated rows count once, and
    a row with the anchor's vec_id is no positive of it. Ties go to the smaller vec_id; an anchor without positives, and a positive
    without rows in its window (a negative score has none), have no row. Components beyond ``LARGEST`` / ``SCALE`` (65,536) count as
    that. Empty tables give no row; other columns are not read.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole(F.col("embedding"), SCALE, LARGEST).alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    within = folder(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n = -(-asked.count() // BLOCK)
    if not n:
        return spark.createDataFrame([], schema)
    asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n))).write.partitionBy("block").parquet(f"{within}/asked")
    blocks = spark.read.schema("vec_id long, label long, v array<int>, block long").parquet(f"{within}/asked")
    for k in range(n):
        block = _Block(blocks.where(F.col("block") == k).orderBy("vec_id", "label", "v").collect())
        if not len(block.ids):
            continue
        held = spark.sparkContext.broadcast(block)
        found: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        for r in _merged(rows.mapInArrow(_best(held, None, None, positives), _FOUND), positives).collect():
            found[r.anchor] = [(x.id, -x.under) for x in r.best]
        upper, lower, own = _windows(found, low, high)
        if (upper != NONE).any():
            told = [(i, int(block.ids[i]), p, s, slot, a) for i in range(len(found)) for (p, s), (slot, a) in zip(found[i], own[i], strict=True) if slot >= 0]
            windows = spark.createDataFrame(told, "anchor long, anchor_id long, positive_id long, positive_score long, slot int, least long")
            best = _merged(rows.mapInArrow(_best(held, upper, lower, negatives), _FOUND), negatives).join(F.broadcast(windows), "anchor")
            suffix = F.slice(F.filter("best", lambda x: x["slot"] >= F.col("slot")), 1, negatives)
            best = best.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter(suffix, lambda x: -x["under"] >= F.col("least"))).alias("place", "x"))
            best = best.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.under")).alias("negative_score"))
            best.write.mode("append").parquet(f"{within}/found")
        held.destroy()
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{within}/found")  # so that there is a table
    return spark.read.schema(schema).parquet(f"{within}/found")
