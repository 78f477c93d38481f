"""Benchmark decontamination: rare word pairs of test items seed passages, Smith-Waterman alignment scores them.

The benchmark is the stated query set and is taken in blocks of bounded size; every document meets every block. Seeds are
an item's pairs of neighbouring words (its bigrams); in a document the two words may have up to ``REACH - 1`` others between
them. One scan counts in how many documents each pair of a block occurs, and every item leaves out its most frequent pairs,
only as many as it can spare: the score bounds the points that a passage may lose, so how many pairs any edits can break,
and ``need`` seeds stay whole (``broken_pairs``). A second scan finds the seeds, aligns the words around ``need`` of them
with the item's words and keeps passages whose score is at least ``MIN_SCORE`` of a verbatim copy's; a passage that shares
too few words to score that much is not aligned. No passage of that score is lost. No text is shuffled.

The corpus is read twice for every ``BLOCK_CHARS`` characters of benchmark, so once more for each further block that size.

Defined results: null and empty texts and items match nothing; very long texts and items are handled whole (alignment holds
two rows of its table); an item under ``LEAST_WORDS`` words matches nothing; a short item is matched by what scores enough,
as two of three words that stand together; of repeated passages of one item in one document the best (ties: the first) is
returned; repeated rows are judged one by one; a null doc_id or item_id is returned as null; an empty table gives no row, an
empty benchmark finds nothing; without_contaminated keeps every further column, whatever its name, contaminated reads none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

REACH, LEAST_WORDS, MIN_SCORE = 2, 3, 0.6
MATCH, MISS, GAP = 2, -1, -1
BLOCK_CHARS = 16_000_000
PAIR_FACTOR = 0xC2B2AE3D27D4EB4F


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: best score as a share of a perfect copy's, first and last word of the passage in it."""
    width = len(passage)
    cells = np.zeros(width + 1, np.int64)
    came = np.arange(width + 1)  # where the best passage that ends in a cell began; of the row above only
    slope = -GAP * np.arange(width + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = np.concatenate([[0], cells[:-1] + np.where(passage == word, MATCH, MISS)])
        above = cells + GAP
        new = np.maximum(np.maximum(diagonal, above), 0)
        origin = np.where(new == 0, np.arange(width + 1), np.where(diagonal >= above, np.concatenate([[0], came[:-1]]), came))
        lifted = new + slope  # a gap along the row: the best cell to the left, less its distance
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(width + 1), 0))
        cells = reach - slope
        came = origin[source]
        top = int(cells.argmax())
        if cells[top] > best[0]:
            best = (int(cells[top]), int(came[top]), top)
    return best[0] / (MATCH * max(1, len(item))), best[1], best[2]


def broken_pairs(points: np.ndarray) -> np.ndarray:
    """The most pairs of neighbouring words that edits of so many points can break.

    A word replaced or removed costs at least 3 points (its match and a miss or gap) and breaks two pairs; a run of them costs
    more a pair. A word cut off at an end costs 2 and breaks one, and so do ``REACH`` words inserted between two others; fewer
    leave the pair within reach.
    """
    edits, rest = np.divmod(points, MATCH - MISS)
    return 2 * edits + rest // min(MATCH, REACH * -GAP)


def pairs(value: np.ndarray, text: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each ordered pair of words of one text that are at most ``reach`` apart."""
    found = []
    for step in range(1, reach + 1):
        at = np.flatnonzero(text[:-step] == text[step:])
        found.append((words.mix(value[at] * np.uint64(PAIR_FACTOR) + value[at + step]), text[at], at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Names:
    """Sorted pair hashes, behind a table of their leading bits that turns most others away."""

    def __init__(self, gram: np.ndarray):
        self.sorted = np.unique(gram)
        self.shift = np.uint64(64 - max(10, int(16 * len(self.sorted)).bit_length()))
        self.some = np.zeros(1 << int(64 - self.shift), bool)
        self.some[self.sorted >> self.shift] = True

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``gram`` that hold one of the names, and which."""
        maybe = np.flatnonzero(self.some[gram >> self.shift])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.sorted, gram[maybe]), len(self.sorted) - 1)
        same = self.sorted[at] == gram[maybe]
        return maybe[same], at[same]


class Items:
    """Words and pairs of a block of test items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.words: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(rows)
        grams, item, place = [], [], []
        for first, _, data, offsets in words.slices(pa.array([r[1] for r in rows], pa.string())):
            start, end, text = words.split(data, offsets, words.PUNCTUATED)
            value = words.hashes(data, start, end)
            cut = np.searchsorted(text, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                self.words[first + i] = value[cut[i] : cut[i + 1]]
            gram, of, at = pairs(value, text, 1)
            long = np.diff(cut)[of] >= LEAST_WORDS
            grams.append(gram[long])
            item.append(first + of[long])
            place.append((at - cut[of])[long])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.gram, self.item, self.place = join(grams, np.uint64), join(item, np.int64), join(place, np.int64)
        self.names = Names(self.gram)

    def keep_rare(self, df: np.ndarray) -> None:
        """Drop the most frequent pairs that no item needs: whatever words are edited, ``need`` seeds stay whole."""
        own = df[np.searchsorted(self.names.sorted, self.gram)]
        held = np.bincount(self.item, minlength=len(self.ids))
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.spare = np.floor(MATCH * self.length * (1 - MIN_SCORE) + 1e-9).astype(np.int64)  # points a passage may lose
        broken = broken_pairs(self.spare)
        self.need = np.maximum(1, -(-(held - broken) // 3))
        order = np.lexsort((self.place, own, self.item))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        order = order[rank < (broken + self.need)[self.item[order]]]
        order = order[np.lexsort((self.place[order], self.item[order], self.gram[order]))]
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.names = Names(self.gram)


def _grams(texts: pa.Array) -> Iterator[tuple]:
    for first, last, data, offsets in words.slices(texts):
        start, end, text = words.split(data, offsets, words.PUNCTUATED)
        value = words.hashes(data, start, end)
        yield first, last, value, text, *pairs(value, text, REACH)


def _frequency(items) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = items.value.names
        n = max(1, len(names.sorted))
        held = np.zeros(len(names.sorted), np.int64)
        for batch in batches:
            for *_, gram, text, _ in _grams(batch.column(0)):
                found, which = names.hits(gram)
                seen, times = np.unique(np.unique(text[found] * n + which) % n, return_counts=True)
                held[seen] += times
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], ["gram", "n"])

    return run


def _crowded(row: np.ndarray, item: np.ndarray, diagonal: np.ndarray, need: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Which of the sorted hits are among ``need`` of one row and item whose diagonals differ by no more than gaps can move them."""
    first = np.arange(len(row))
    last = first + need[item] - 1
    inside = np.flatnonzero(last < len(row))
    first, last = inside, last[inside]
    near = (row[first] == row[last]) & (item[first] == item[last])
    near &= diagonal[last] - diagonal[first] <= spare[item[first]]
    change = np.zeros(len(row) + 1, np.int64)
    change[first[near]] += 1
    np.subtract.at(change, last[near] + 1, 1)
    return np.cumsum(change[:-1]) > 0


def passages(items: Items, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word) of the passages in a column of texts, the best for each row and item."""
    for first, _, value, text, gram, of, at in _grams(texts):
        found, which = items.names.hits(gram)
        if not len(found):
            continue
        low = np.searchsorted(items.gram, items.names.sorted[which], "left")
        high = np.searchsorted(items.gram, items.names.sorted[which], "right")
        each = np.repeat(np.arange(len(found)), high - low)
        entry = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        row, item, place = of[found[each]], items.item[entry], items.place[entry]
        diagonal = at[found[each]] - place
        order = np.lexsort((diagonal, item, row))
        order = order[_crowded(row[order], item[order], diagonal[order], items.need, items.spare)]
        if not len(order):
            continue
        row, item, place, diagonal = row[order], item[order], place[order], diagonal[order]
        apart = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > items.spare[item[1:]])])
        heads = np.flatnonzero(apart)
        begin = np.searchsorted(text, np.arange(int(text[-1]) + 2))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, b in zip(heads, np.append(heads[1:], len(row)), strict=True):
            r, i = int(row[a]), int(item[a])
            if len(np.unique(place[a:b])) < items.need[i]:
                continue
            m = int(items.length[i])
            wide = int(items.spare[i]) // -GAP  # no more words can be inserted
            left, right = max(int(begin[r]), int(diagonal[a]) - wide), min(int(begin[r + 1]), int(diagonal[b - 1]) + m + wide)
            if MATCH * m - MATCH * np.isin(items.words[i], value[left:right]).sum() > items.spare[i]:
                continue
            score, x, y = align(items.words[i], value[left:right])
            if score >= MIN_SCORE and score > best.get((r, i), (0.0,))[0]:
                best[r, i] = (score, left - int(begin[r]) + x, left - int(begin[r]) + y)
        for (r, i), (score, x, y) in best.items():
            yield first + r, i, score, x, y


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast blocks of test items with their seeds; a block holds about ``BLOCK_CHARS`` characters."""
    spark = docs.sparkSession
    held = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text is not null")
    chars = held.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        rows = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        items = Items([(r[0], r[1]) for r in rows])
        asked = spark.sparkContext.broadcast(items)
        counts = docs.select("text").mapInArrow(_frequency(asked), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
        asked.destroy()
        df = np.zeros(len(items.names.sorted), np.int64)
        df[counts.gram.to_numpy(np.int64)] = counts.n.to_numpy(np.int64)
        items.keep_rare(df)
        yield spark.sparkContext.broadcast(items)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of every passage. docs needs doc_id and text, benchmark item_id and text."""

    def find(items) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(passages(items.value, batch.column(1)))
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.record_batch([ids, pa.array([items.value.ids[x[1]] for x in found], pa.int64()), pa.array([round(x[2], 4) for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64())], ["doc_id", "item_id", "score", "first_word", "last_word"])

        return run

    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(docs, benchmark):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(find(items), schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item; every column is kept."""

    def drop(items, at: int) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in passages(items.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for items in _blocks(docs, benchmark):
        docs = docs.mapInArrow(drop(items, docs.columns.index("text")), docs.schema)
    return docs
