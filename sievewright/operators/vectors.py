"""Chunks, incremental embedding and scoring with a caller's models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def cut(text: str | None, chars: int = 4000, overlap: int = 400) -> list[str]:
    """Windows of ``chars`` characters that begin ``overlap`` before the last one's end.

    A window ends at its last newline or space if that lies beyond 60 % of it; pieces are trimmed, empty ones go.
    """
    text = (text or "").replace("\r\n", "\n").strip()
    if len(text) <= chars:
        return [text]
    pieces, start = [], 0
    while True:
        stop = min(len(text), start + chars)
        if stop < len(text) and (gap := max(text.rfind("\n", 0, stop + 1), text.rfind(" ", 0, stop + 1))) > start + int(chars * 0.6):
            stop = gap
        pieces.append(text[start:stop].strip())
        if stop == len(text):
            return [p for p in pieces if p]
        start = max(start + 1, stop - overlap)


def chunks(catalog: DataFrame, chars: int = 4000, overlap: int = 400) -> DataFrame:
    """(doc_id, position, text, content_hash): a document's name and description stand before each piece of its body."""

    @F.pandas_udf("array<string>")
    def pieces(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda t: cut(t, chars, overlap))

    held = catalog.select("doc_id", "name", "description", F.posexplode(pieces("body")).alias("position", "piece"))
    text = tx.document_text(F.col("name"), F.col("description"), F.col("piece"), 320, chars)
    return held.select("doc_id", "position", text.alias("text")).withColumn("content_hash", tx.content_hash(F.col("text")))


def manifest(chunk_table: DataFrame) -> DataFrame:
    return chunk_table.groupBy("doc_id").agg(F.count("*").alias("chunks"))


def cache_key(chunk_table: DataFrame, model: str) -> DataFrame:
    return chunk_table.withColumn("key", F.sha2(F.concat_ws("\x00", F.lit(model), F.col("doc_id").cast("string"), "content_hash", F.col("position").cast("string")), 256))


def to_embed(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("key"), "key", "left_anti")


def still_valid(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return cache.join(keyed.select("key"), "key", "left_semi")


def encode(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16) -> DataFrame:
    """texts with column text; ``embedding`` is the normalized vector of the caller's model, loaded once a Python worker."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for held in series:
            rows: list[np.ndarray] = []
            for i in range(0, len(held), batch):
                v = np.asarray(model(held.iloc[i : i + batch].fillna("").tolist()), np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                rows += list((v / np.where(norm > 0, norm, 1)).astype(np.float32))
            yield pd.Series(rows)

    return texts.withColumn("embedding", run("text"))


def hashing_encoder(size: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in for a model: signed counts of hashed words."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import xxhash

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    out[i, h % size] += 1 if h >> 63 else -1
            return out

        return run

    return load


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 16) -> DataFrame:
    """pairs with prompt and body; ``score`` of the caller's model, clamped to [0, 1]; rows without a finite score go."""

    @F.pandas_udf("double")
    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in columns:
            yield pd.Series([s for i in range(0, len(a), batch) for s in model(a.iloc[i : i + batch].tolist(), b.iloc[i : i + batch].tolist())])

    held = pairs.withColumn("raw", run("prompt", "body"))
    finite = F.col("raw").isNotNull() & ~F.isnan("raw") & (F.abs("raw") != float("inf"))
    return held.where(finite).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "raw"))).drop("raw")


def invalid_vectors(table: DataFrame, size: int) -> DataFrame:
    """Vectors of another size or with a value that is not finite."""
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table.where(F.col("embedding").isNull() | (F.size("embedding") != size) | odd)
