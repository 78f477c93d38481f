"""Language identification of mixed-language texts.

Learning counts hashed letter trigrams and scripts by language over a hash sample of about ``TRAIN_DOCS`` labelled
documents (all if there are fewer). Prediction scores every word by its trigrams; the word's script range leaves only the
languages that were seen to use it; Viterbi with a switching penalty labels the words, and equal neighbours form spans.

Most texts need no dynamic programme: if no run of words gains more than half a switch by another language than the best
one, the single-language path is the Viterbi path (a path with m runs outside the best language has m - 1 switches or
more, and with one such run, one). All others run through the recursion, many texts at a time.

Learning is bounded by ``TRAIN_DOCS``, a documented sample by hash of doc_id; rows with a null doc_id are in it whenever all
rows are.

Defined results: null or empty text, or text without a letter: language ``und``, score 0, no span; very long texts are scored
whole, in pieces; repeated rows get equal results; ties go to the language that comes first in order; no training row:
``und`` for all; an empty table gives no row; further columns are kept, whatever their names, but for ``lang_pred``,
``score`` and ``spans``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

TRAIN_DOCS = 20_000
FEATURE_BITS = 15
SWITCH = 12.0
PIECE_BYTES, PREDICT_BYTES = 1 << 18, 2 << 20
SCRIPT_SHARE = 0.01
NO_LANGUAGE = "und"

# Code point ranges of scripts, the last code point included; what lies in none is no letter.
RANGES = [
    ("Latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F), (0xFB13, 0xFB17)]),
    ("Hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)]),
    ("Syriac", [(0x700, 0x74F)]), ("Thaana", [(0x780, 0x7BF)]), ("NKo", [(0x7C0, 0x7FF)]),
    ("Devanagari", [(0x900, 0x97F), (0xA8E0, 0xA8FF)]), ("Bengali", [(0x980, 0x9FF)]), ("Gurmukhi", [(0xA00, 0xA7F)]), ("Gujarati", [(0xA80, 0xAFF)]), ("Oriya", [(0xB00, 0xB7F)]),
    ("Tamil", [(0xB80, 0xBFF)]), ("Telugu", [(0xC00, 0xC7F)]), ("Kannada", [(0xC80, 0xCFF)]), ("Malayalam", [(0xD00, 0xD7F)]), ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]), ("Lao", [(0xE80, 0xEFF)]), ("Tibetan", [(0xF00, 0xFFF)]), ("Myanmar", [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)]),
    ("Ethiopic", [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)]), ("Cherokee", [(0x13A0, 0x13FF), (0xAB70, 0xABBF)]), ("Canadian", [(0x1400, 0x167F), (0x18B0, 0x18FF)]),
    ("Khmer", [(0x1780, 0x17FF)]), ("Mongolian", [(0x1800, 0x18AF)]), ("Tifinagh", [(0x2D30, 0x2D7F)]),
    ("Kana", [(0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]), ("Bopomofo", [(0x3100, 0x312F)]), ("Yi", [(0xA000, 0xA4CF)]),
    ("Han", [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]),
    ("Historic", [(0x10000, 0x1CFFF), (0x1E000, 0x1EFFF)]),
]
N_SCRIPTS = len(RANGES) + 1
_spans = sorted((a, b, k) for k, (_, held) in enumerate(RANGES, 1) for a, b in held)
_FIRST, _LAST, _SCRIPT = (np.array(x) for x in zip(*_spans, strict=True))
SCRIPTS = np.zeros(256, np.uint8)  # of ASCII
SCRIPTS[[*range(65, 91), *range(97, 123)]] = 1
GAPS = np.ones(256, bool)
GAPS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _buckets(data: np.ndarray) -> np.ndarray:
    """Trigram bucket of every byte (the last bucket for bytes between words); ``data`` begins where a word begins."""
    gap = GAPS[data]
    b = np.where(gap, 32, words.LOWER[data]).astype(np.uint64)
    one = np.concatenate([[32], b[:-1]]).astype(np.uint64)
    two = np.concatenate([[32, 32], b[:-2]]).astype(np.uint64)[: len(b)]
    two[one == 32] = 32
    bucket = (((two << np.uint64(16) | one << np.uint64(8) | b) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    bucket[gap] = 1 << FEATURE_BITS
    return bucket


def _pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first word, word after the last, bucket of each byte from the first word on), a few hundred kilobytes of whole words of one text or several.

    Two texts may touch without a gap, so a piece also ends where the next text begins at once.
    """
    touching = np.flatnonzero((text[1:] != text[:-1]) & (start[1:] == end[:-1])) + 1
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + PIECE_BYTES, "right")))
        k = int(np.searchsorted(touching, first, "right"))
        if k < len(touching):
            last = min(last, int(touching[k]))
        yield first, last, _buckets(data[start[first] : end[last - 1]])
        first = last


def byte_scripts(data: np.ndarray) -> np.ndarray:
    """The script of the letter that begins at each byte of UTF-8 text; 0: no letter."""
    out = SCRIPTS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        code = data[lead].astype(np.int64)
        more = 1 + (code >= 0xE0) + (code >= 0xF0)
        code &= 0x3F >> more
        for k in (1, 2, 3):
            wide = more >= k
            code[wide] = code[wide] << 6 | data[np.minimum(lead[wide] + k, len(data) - 1)] & 0x3F
        at = np.maximum(np.searchsorted(_FIRST, code, "right") - 1, 0)
        out[lead] = np.where((code >= _FIRST[at]) & (code <= _LAST[at]), _SCRIPT[at], 0)
    return out


def _word_scripts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(byte_scripts(data), start) if len(start) else np.zeros(0, np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    size = (1 << FEATURE_BITS) + 1 + N_SCRIPTS
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for first, last, data, offsets in words.slices(batch.column(0)):
            if not len(data):
                continue
            start, end, text = words.split(data, offsets, GAPS)
            script = _word_scripts(data, start).astype(np.int64) + (1 << FEATURE_BITS) + 1
            lang = langs[first:last][text]
            for a, b, bucket in _pieces(data, start, end, text):
                owner = np.repeat(np.arange(a, b), np.diff(np.append(start[a:b], end[b - 1])))
                for one in set(lang[a:b]):
                    mine = lang[a:b] == one
                    n = held.setdefault(one, np.zeros(size, np.int64))
                    n += np.bincount(bucket[mine[owner - a]], minlength=size)
                    n += np.bincount(script[a:b][mine], minlength=size)
    for lang, n in held.items():
        n[1 << FEATURE_BITS] = 0
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["lang", "feature", "n"])


class Model:
    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts.lang.unique())
        size = 1 << FEATURE_BITS
        n = np.zeros((size + 1 + N_SCRIPTS, max(1, len(self.langs))))
        for k, lang in enumerate(self.langs):
            mine = counts[counts.lang == lang]
            n[mine.feature.to_numpy(np.int64), k] = mine.n.to_numpy()
        log = np.log((n[:size] + 0.5) / (n[:size].sum(0) + 0.5 * size))
        self.log = np.vstack([log - log.mean(1, keepdims=True), np.zeros((1, log.shape[1]))]).astype(np.float32)
        share = n[size + 1 :] / np.maximum(1, n[size + 1 :].sum(0))
        self.known = share >= SCRIPT_SHARE
        self.known[~self.known.any(1)] = True  # a script that no language uses tells nothing


def learn(docs: DataFrame) -> Model:
    """docs needs doc_id, text and lang; rows with a null lang or text teach nothing."""
    docs = docs.where("lang is not null and text is not null")
    n = docs.count()
    if n > TRAIN_DOCS:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < TRAIN_DOCS * 1_000_000 // n)
    return Model(docs.select("text", "lang").mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas())


def viterbi(score: np.ndarray, heads: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; ``score`` has the words of all texts one after another."""
    total, n = score.shape
    out = np.zeros(total, np.int64)
    if not total:
        return out
    best = np.add.reduceat(score, heads, axis=0).argmax(1)
    of = np.repeat(np.arange(len(heads)), counts)
    out[:] = best[of]
    hard = np.zeros(len(heads), bool)
    shift = np.arange(len(heads)) * -1e6
    for k in range(n):
        gain = (score[:, k] - score[np.arange(total), out]).astype(np.float64)
        run = np.cumsum(gain)
        run -= np.repeat(run[heads] - gain[heads], counts)  # from 0 at each text's head
        before = np.concatenate([[0.0], run[:-1]])
        before[heads] = 0.0
        before += shift[of]
        hard |= np.maximum.reduceat(run + shift[of] - np.minimum.accumulate(before), heads) > switch / 2
    hard = np.flatnonzero(hard)
    hard = hard[np.argsort(-counts[hard], kind="stable")]
    if not len(hard):
        return out
    state = score[heads[hard]].astype(np.float64)
    steps: list[np.ndarray] = []
    length = counts[hard]
    for t in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -t, "left"))  # texts with more than t words
        top = state[:live].argmax(1)
        jump = state[np.arange(live), top] - switch
        stay = state[:live] >= jump[:, None]
        steps.append(np.where(stay, np.arange(n), top[:, None]).astype(np.int16))
        state[:live] = np.where(stay, state[:live], jump[:, None]) + score[heads[hard[:live]] + t]
    now = state.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        out[heads[hard[:live]] + t] = now[:live]
        if t:
            now[:live] = steps[t - 1][np.arange(live), now[:live]]
    return out


def predict(model: Model, texts: pa.Array) -> tuple[list[str], list[float], list[str]]:
    """Language, score and spans (``language:first word:word after the last``) of every text."""
    rows = len(texts)
    langs, scores, spans = [NO_LANGUAGE] * rows, [0.0] * rows, [""] * rows
    for first, last, data, offsets in words.slices(texts, PREDICT_BYTES):
        if not model.langs or not len(data):
            continue
        start, end, text = words.split(data, offsets, GAPS)
        if not len(start):
            continue
        score = np.empty((len(start), len(model.langs)), np.float32)
        for a, b, bucket in _pieces(data, start, end, text):
            score[a:b] = np.add.reduceat(model.log[bucket], start[a:b] - start[a], axis=0)
        script = _word_scripts(data, start)
        score = np.where(model.known[script], score, np.float32(-50))
        score[script == 0] = 0
        heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        counts = np.diff(np.append(heads, len(text)))
        label = viterbi(score, heads, counts)
        size = end - start
        weight = np.zeros((last - first, len(model.langs)))
        np.add.at(weight, (text, label), size)
        top = weight.argmax(1)
        change = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (label[1:] != label[:-1])]))
        until = np.append(change[1:], len(text))
        head_of = np.repeat(heads, counts)
        for t in text[heads]:
            held = data[offsets[t] : offsets[t + 1]]
            if (SCRIPTS[held[held < 128]] > 0).any() or any(c.isalpha() for c in held.tobytes().decode("utf-8", "replace")):
                langs[first + t] = model.langs[top[t]]
                scores[first + t] = round(float(weight[t, top[t]] / weight[t].sum()), 6)
        for a, b in zip(change, until, strict=True):
            if langs[first + text[a]] != NO_LANGUAGE:
                one = f"{model.langs[label[a]]}:{a - head_of[a]}:{b - head_of[a]}"
                spans[first + text[a]] += ("," if spans[first + text[a]] else "") + one
    return langs, scores, spans


def label_languages(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with lang_pred, score and spans added; these three names are replaced if docs has them."""
    model = docs.sparkSession.sparkContext.broadcast(learn(training))
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("lang_pred", "score", "spans")))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, spans = predict(model.value, batch.column(at))
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], [*batch.schema.names, "lang_pred", "score", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, spans string")
