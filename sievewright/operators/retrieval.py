"""Candidates for prompts: lexical and vector top-k, fusion, reranking and the hybrid decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.terms import Alphabet, Cutter, alphabet
from ..sources.shared import discard, folder, stored
from . import index, vectors
from .best import Best

NAME_WEIGHT, DESCRIPTION_WEIGHT, PHRASE_WEIGHT = 6, 2, 12
MIN_SCORE, MIN_SIMILARITY, MARGIN = 2, 0.42, 0.04
RRF, DEPTH = 60, 20
GRAM = 4
WORD, MARK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
QUERY_BLOCK, WIDE, POOL_SHARD = 4096, 4, 65_536
SCORE_CELLS = 2_000_000
#: Bits of a filter of candidates, a fixed size.
CANDIDATES = 1 << 25
#: What a product of 32-bit numbers up to 1 is off by, at most, for each component of unit vectors; pairs scored exactly at once.
ROUGH, DOTS = 1.2e-7, 65_536


def phrase_matches(prompts: DataFrame, names: DataFrame) -> DataFrame:
    """(prompt_id, name) where the prompt holds the name.

    Exact blocking: a name meets the prompts that hold its rarest four characters (shorter names: the whole name); a name
    with a substring that no prompt holds cannot match. What meets is verified. Prompts give only grams of lengths that occur.
    """
    names = names.select("name").where("name <> ''").distinct()
    sizes = sorted(r[0] for r in names.select(F.least(F.length("name"), F.lit(GRAM)).alias("size")).distinct().collect())
    text = F.lower("prompt").alias("p")
    held = prompts.select("prompt_id", text).select("prompt_id", "p", F.explode(index.substrings(F.col("p"), sizes or [GRAM])).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    name = F.lower("name")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (GRAM - 1), F.lit(1))), lambda i: F.substr(name, i, F.lit(GRAM)))
    each = names.select("name", F.explode(F.array_distinct(grams)).alias("gram")).join(counts.hint("merge"), "gram", "left")
    rarest = each.groupBy("name").agg(F.min_by("gram", "n").alias("gram"), F.max(F.col("n").isNull()).alias("absent")).where("not absent")
    return held.hint("merge").join(rarest, "gram").where(F.contains("p", F.lower("name"))).select("prompt_id", "name")


def word_matches(prompts: DataFrame, names: DataFrame) -> DataFrame:
    """(prompt_id, name) where the prompt holds the name, less its marks at both ends, from the start of a word to the end of a word; names without a word have no row.

    Names meet equal stretches of the prompts, so what meets grows with the matches. A prompt gives only stretches of as many words
    as a name has. Joins are merges: Spark takes exploded rows for as small as their table and would broadcast them.
    """
    pieces = lambda c: F.regexp_extract_all(c, F.lit(f"({WORD}+|{MARK}+)"), F.lit(1))
    names = names.select("name", F.regexp_replace("name", f"^{MARK}+|{MARK}+$", "").alias("core")).where("core <> ''").distinct()
    sizes = sorted(r[0] for r in names.select(F.size(pieces(F.col("core"))).alias("size")).distinct().collect())
    if not sizes:
        return prompts.select("prompt_id", F.lit("").alias("name")).limit(0)
    said = prompts.select("prompt_id", pieces(F.regexp_replace("prompt", f"^{MARK}+", "")).alias("own"))
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.size("own") - n + 1, F.lit(2)), lambda i: F.array_join(F.slice("own", i, n), ""))
    stretches = F.flatten(F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.size("own")), of_size))
    held = said.select("prompt_id", F.explode(F.array_distinct(stretches)).alias("core"))
    return held.hint("merge").join(names, "core").select("prompt_id", "name")


def ranked(scored: DataFrame, top: int, *order: Column) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("prompt_id").orderBy(*order))).where(F.col("rank") <= top)


def lexical_top(prompts: DataFrame, catalog: DataFrame | index.Index, top: int = 2, min_score: float = MIN_SCORE, body_weight: float = 0) -> DataFrame:
    """(prompt_id, doc_id, score, matches, rank): terms shared with name and description, and whole names in the prompt.

    catalog: an index, or a table that is indexed first. Descriptions are what a catalog entry shows: `catalog.from_documents`
    takes the first ``DESCRIPTION_SIZE`` characters of a text. With a ``body_weight`` the terms of the whole body count too, so that
    any part of a text can be found (0: bodies count in `rerank_blend` only). A prompt without a term has no candidates.
    """
    weights = [NAME_WEIGHT, DESCRIPTION_WEIGHT, body_weight, PHRASE_WEIGHT]
    if isinstance(catalog, index.Index):
        return index.search(prompts, catalog, top, min_score, weights)
    held = index.build(catalog, body=body_weight > 0)
    found = index.search(prompts, held, top, min_score, weights)
    discard(held.spark, held.root)
    return found


def exact_name_matches(prompts: DataFrame, catalog: DataFrame, max_entries: int = 300, min_chars: int = 4) -> DataFrame:
    """(prompt_id, doc_id) of prompts that name exactly one entry; only for catalogs of up to ``max_entries``, which is checked first."""
    if max_entries < 1 or catalog.count() > max_entries:
        return prompts.sparkSession.createDataFrame([], "prompt_id long, doc_id long")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s_-]+", " "))
    own = catalog.where(F.length(F.regexp_replace("name", r"[-_\s]", "")) >= min_chars).select("doc_id", plain(F.col("name")).alias("name"))
    within = folder(prompts.sparkSession, "exact")  # the catalog is read once
    names = stored(own.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "names", within)
    said = prompts.select("prompt_id", plain(F.col("prompt")).alias("prompt"))
    met = word_matches(said, names)
    wordless = names.where(~F.col("name").rlike(WORD))
    if not wordless.isEmpty():
        met = met.union(phrase_matches(said, wordless))
    bounded = F.concat(F.lit(rf"(^|{MARK})\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E($|{MARK})"))
    held = met.hint("merge").join(said, "prompt_id").where(F.rlike("prompt", bounded)).hint("merge").join(names, "name")
    found = stored(held.groupBy("prompt_id").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("prompt_id", "doc_id"), "exact")
    discard(prompts.sparkSession, within)
    return found


def _vectors(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each size, straight from the Arrow buffers."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    head = np.cumsum(size) - size
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[head[rows][:, None] + np.arange(n)]


def _unit(m: np.ndarray) -> np.ndarray:
    return np.divide(m, np.sqrt((m * m).sum(1))[:, None], out=np.zeros_like(m), where=(m != 0).any(1)[:, None])


def _dots(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Similarities of pairs of rows, to nine digits."""
    cuts = [slice(a, a + DOTS) for a in range(0, len(i), DOTS)]
    return np.round(np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", left[i[c]], right[j[c]]) for c in cuts)]), 9)


def _nearest(ids: np.ndarray, lists: pa.ListArray, batches: Iterator[tuple[np.ndarray, np.ndarray, pa.ListArray]], top: int, floor: float) -> tuple[np.ndarray, ...]:
    """(query, row, similarity, text): the best rows of different texts of the batches for each query, by vectors of the same size."""
    asked = {m.shape[1]: (ids[at], _unit(m)) for at, m in _vectors(lists)}
    kept = {size: Best(len(own), top, floor) for size, (own, _) in asked.items()}
    for rows, texts, held in batches:
        for at, matrix in _vectors(held):
            if matrix.shape[1] in kept:
                mine = asked[matrix.shape[1]][1]
                rough = mine.astype(np.float32)
                step = max(1, SCORE_CELLS // len(mine))
                for i in range(0, len(at), step):
                    part, other = at[i : i + step], _unit(matrix[i : i + step])
                    exact = lambda query, column: _dots(mine, query, other, column)  # noqa: E731, B023
                    kept[matrix.shape[1]].add(rough @ other.astype(np.float32).T, (matrix.shape[1] + 8) * ROUGH, exact, rows[part], texts[part])
    found = [(asked[size][0][query], at, score, text) for size, one in kept.items() for query, score, at, text in [one.rows()]]
    return tuple(np.concatenate([np.asarray(f[j], kind) for f in found] or [np.zeros(0, kind)]) for j, kind in enumerate((np.int64, np.int64, np.float64, np.int64)))


_NEAR = "prompt_id long, doc_id long, score double, text long"


def _by_broadcast(queries: DataFrame, pool: DataFrame, top: int, floor: float) -> DataFrame:
    rows = queries.collect()
    held = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = held.value
        given = ((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)) for b in batches)
        yield pa.record_batch([pa.array(x) for x in _nearest(ids, pa.array(own, pa.list_(pa.float64())), given, top, floor)], ["prompt_id", "doc_id", "score", "text"])

    return pool.mapInArrow(best, _NEAR)


def _by_grid(queries: DataFrame, pool: DataFrame, top: int, floor: float, blocks: int, shards: int) -> DataFrame:
    """Cells of a block of queries and a shard of the pool meet in one task each; both sides are dealt by hash."""
    dealt = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("prompt_id", "embedding", dealt(["prompt_id", "embedding"], blocks).alias("block"), every(shards).alias("shard"))
    given = pool.select("doc_id", "text", "embedding", dealt(["doc_id", "embedding"], shards).alias("own_shard"), every(blocks).alias("own_block"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        vectors_ = lambda t: t.column("embedding").combine_chunks()
        found = _nearest(left.column("prompt_id").to_numpy(), vectors_(left), iter([(right.column("doc_id").to_numpy(), right.column("text").to_numpy(), vectors_(right))]), top, floor)
        return pa.table(dict(zip(("prompt_id", "doc_id", "score", "text"), found, strict=True)))

    return asked.groupBy("block", "shard").cogroup(given.groupBy("own_block", "own_shard")).applyInArrow(best, _NEAR)


def vector_top(queries: DataFrame, pool: DataFrame, top: int, floor: float = -1.0) -> DataFrame:
    """(prompt_id, doc_id, score, rank): queries (prompt_id, embedding) against pool (doc_id, embedding), by cosine.

    Up to ``QUERY_BLOCK`` queries are broadcast and the pool is scanned once, without a shuffle. More of them meet the pool on a grid
    of query blocks (``WIDE`` such, fewer if tasks would be idle) and pool shards (``POOL_SHARD`` vectors): neither side passes through the driver, and a cell is bounded however
    large both are. A task or cell hands on its best ``top`` of a query; a window picks the best of those. Different sizes do
    not meet, a zero vector has similarity 0, ties go to the lesser id; null vectors take no part.
    If the pool has a column text (long), only the best document of each text counts.
    """
    by_text = "text" in pool.columns
    queries = queries.where("embedding is not null").select(F.col("prompt_id").cast("long"), F.col("embedding").cast("array<double>"))
    own = F.col("embedding") if dict(pool.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    doc = F.col("doc_id").cast("long")
    pool = pool.where("embedding is not null").select(doc.alias("doc_id"), (F.col("text") if by_text else doc).alias("text"), own.alias("embedding"))
    n = queries.count()
    if n <= QUERY_BLOCK:
        found = _by_broadcast(queries, pool, top, floor)
    else:
        shards = max(1, -(-pool.count() // POOL_SHARD))
        idle = -(-2 * queries.sparkSession.sparkContext.defaultParallelism // shards)
        found = _by_grid(queries, pool, top, floor, max(-(-n // (WIDE * QUERY_BLOCK)), min(-(-n // QUERY_BLOCK), idle)), shards)
    if by_text:
        found = found.withColumn("n", F.row_number().over(W.partitionBy("prompt_id", "text").orderBy(F.desc("score"), F.col("doc_id")))).where("n = 1").drop("n")
    return ranked(found.drop("text"), top, F.desc("score"), F.col("doc_id"))


def max_pool(chunk_scores: DataFrame) -> DataFrame:
    """Chunk scores (prompt_id, doc_id, score) to document scores, floored at 0."""
    return chunk_scores.groupBy("prompt_id", "doc_id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))


def dedup_by_content(scored: DataFrame) -> DataFrame:
    """scored: prompt_id, doc_id, score, content_hash. The best of each text for a prompt stays."""
    w = W.partitionBy("prompt_id", "content_hash").orderBy(F.desc("score"), F.col("doc_id"))
    return scored.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def ambiguity(ranked_list: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The first of each prompt, and whether the second is within the margin."""
    second = F.lead("score").over(W.partitionBy("prompt_id").orderBy("rank"))
    return ranked_list.withColumn("ambiguous", F.coalesce(F.col("score") - second < margin, F.lit(False))).where("rank = 1")


def semantic_list(asked: DataFrame, pool: DataFrame, catalog: DataFrame, top: int, floor: float = MIN_SIMILARITY, depth: int = DEPTH, margin: float = MARGIN) -> DataFrame:
    """(prompt_id, doc_id, score, rank, ambiguous): the ``max(top, depth)`` best different texts over the floor; none if the best is under it.

    Of copies of a text the best stays; a document that the catalog lacks is a text of its own. Ambiguous is only the
    first of a list that is asked for one document (top = 1), if the second is within the margin. The catalog's content_hash stands for its body, if it has that.
    """
    depth = max(top, depth)
    hashed = F.col("content_hash") if "content_hash" in catalog.columns else tx.content_hash(F.col("body"))
    texts = catalog.select(F.col("doc_id").cast("long"), hashed.alias("content_hash"))
    own = pool.select(F.col("doc_id").cast("long"), "embedding")
    keys = own.select("doc_id").join(texts, "doc_id", "left").withColumn("content_hash", F.coalesce("content_hash", F.col("doc_id").cast("string")))
    firsts = keys.groupBy("content_hash").agg(F.min("doc_id").alias("text"))  # a text's least document stands for it
    best = vector_top(asked, own.join(keys.join(firsts, "content_hash").select("doc_id", "text"), "doc_id"), depth, floor)
    second = F.lead("score").over(W.partitionBy("prompt_id").orderBy("rank"))
    return best.withColumn("ambiguous", F.coalesce(F.lit(top == 1) & (F.col("rank") == 1) & (F.col("score") - second < margin), F.lit(False)))


def fused_pool(semantic: DataFrame, lexical: DataFrame, k: int = DEPTH) -> DataFrame:
    """(prompt_id, doc_id, score, rank, method, ambiguous): both lists in one order by reciprocal ranks, cut to ``k``, for prompts with a semantic list.

    What only the terms found has the score 0, so that a reranker has to lift it.
    """
    own = semantic.select("prompt_id", "doc_id", "score", "ambiguous", F.lit("semantic").alias("method"))
    both = fuse(semantic, lexical.join(semantic.select("prompt_id").distinct(), "prompt_id", "left_semi"), top=k).drop("score")
    held = both.join(own, ["prompt_id", "doc_id"], "left")
    return held.select("prompt_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), "rank", F.coalesce("method", F.lit("lexical")).alias("method"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def fuse(*lists: DataFrame, top: int, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of lists (prompt_id, doc_id, rank)."""
    held = lists[0].select("prompt_id", "doc_id", "rank")
    for more in lists[1:]:
        held = held.unionByName(more.select("prompt_id", "doc_id", "rank"))
    score = F.round(F.sum(1.0 / (k + F.col("rank"))), 9)
    return ranked(held.groupBy("prompt_id", "doc_id").agg(score.alias("score")), top, F.desc("score"), F.col("doc_id"))


def with_bodies(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """candidates with ``body``, read for them only; a candidate that the catalog lacks is an error."""
    candidates = candidates.where("prompt_id IS NOT NULL")  # said before the list is used twice, so that its shuffle is reused
    bodies = candidates.select("doc_id").distinct().join(catalog.select("doc_id", "body", F.lit(True).alias("there")), "doc_id", "left")
    missing = F.raise_error(F.concat(F.lit("candidate without a body: "), F.col("doc_id").cast("string")))
    return candidates.join(bodies, "doc_id").withColumn("body", F.when(F.col("there").isNull(), missing).otherwise(F.col("body"))).drop("there")


def _cut_bodies(letters: Alphabet, wanted: dict[int, bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, there, body) with the different terms of a text; wanted: a bit for the hash of each document that is asked for, others go but for a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = Cutter(letters), index.unpacked(wanted, CANDIDATES)
        for batch in batches:
            batch = batch.filter(pa.array(held[batch.column(1).to_numpy()]))
            sets = pa.array([list(cutter.terms(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([batch.column(0), pa.array(np.ones(batch.num_rows, bool)), sets], ["doc_id", "there", "body"])

    return run


def rerank_blend(candidates: DataFrame, prompts: DataFrame, catalog: DataFrame, top: int) -> DataFrame:
    """max(s, 0.85 s + 0.15 overlap of prompt and body).

    A body is cut into terms once, not for each candidate, and meets the candidates last, so that no text is shuffled.
    """
    asked = candidates.select("prompt_id", "doc_id", "score").join(prompts.select("prompt_id", tx.term_set(F.col("prompt")).alias("asked")), "prompt_id")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(CANDIDATES))
    wanted = index.packed(candidates.select(place.alias("h")))
    texts = catalog.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("h"), F.lower(F.coalesce("body", F.lit(""))).alias("body"))
    bodies = texts.mapInArrow(_cut_bodies(alphabet(catalog.sparkSession), wanted), "doc_id long, there boolean, body array<string>")
    held = asked.hint("merge").join(bodies, "doc_id", "left")
    missing = F.raise_error(F.concat(F.lit("candidate without a body: "), F.col("doc_id").cast("string"))).cast("double")
    shared = F.size(F.array_intersect("body", "asked")) / F.size("asked")
    share = F.when(F.col("there").isNull(), missing).when(F.size("asked") > 0, shared).otherwise(F.lit(0.0))
    blend = F.round(F.greatest(F.col("score"), 0.85 * F.col("score") + 0.15 * share), 9)
    return ranked(held.select("prompt_id", "doc_id", blend.alias("score")), top, F.desc("score"), F.col("doc_id"))


def rerank(candidates: DataFrame, prompts: DataFrame, catalog: DataFrame, top: int, mode: str = "similarity", load: Callable | None = None) -> DataFrame:
    """(prompt_id, doc_id, score, rank). Modes: ``none`` keeps the order, ``similarity`` blends in the overlap with the body, ``model`` scores pairs with the caller's model."""
    if mode == "none":
        return ranked(candidates.select("prompt_id", "doc_id", "score"), top, F.desc("score"), F.col("doc_id"))
    if mode == "similarity":
        return rerank_blend(candidates, prompts, catalog, top)
    if mode != "model" or load is None:
        raise ValueError("mode is none, similarity, or model with a model to load")
    pairs = with_bodies(candidates.select("prompt_id", "doc_id"), catalog).join(prompts.select("prompt_id", "prompt"), "prompt_id")
    return ranked(vectors.score_pairs(pairs, load).select("prompt_id", "doc_id", "score"), top, F.desc("score"), F.col("doc_id"))


def decide(exact: DataFrame, accepted: DataFrame, lexical: DataFrame, asked: DataFrame) -> DataFrame:
    """One method a prompt: exact name, else what was accepted by similarity, else terms where no vector was asked.

    accepted: prompt_id, doc_id, score, rank, method; asked: prompt_id of the prompts that have a query vector. Lexical confidence is
    min(0.6, score / 20).
    """
    first = exact.select("prompt_id", "doc_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit("exact").alias("method"), F.lit(0).alias("priority"))
    middle = accepted.select("prompt_id", "doc_id", "score", "rank", "method", F.lit(1).alias("priority"))
    last = lexical.join(asked, "prompt_id", "left_anti").select("prompt_id", "doc_id", F.least(F.lit(0.6), F.col("score") / 20).alias("score"), "rank", F.lit("lexical").alias("method"), F.lit(2).alias("priority"))
    held = first.unionByName(middle).unionByName(last)
    best = held.groupBy("prompt_id").agg(F.min("priority").alias("priority"))
    return held.join(best, ["prompt_id", "priority"]).drop("priority")


def accept(candidates: DataFrame, prompts: DataFrame, catalog: DataFrame, top: int, reranker: str = "similarity", load: Callable | None = None, floor: float = MIN_SIMILARITY, depth: int = DEPTH) -> DataFrame:
    """(prompt_id, doc_id, score, rank, method): the candidates of `fused_pool` after the reranker, over its floor, ``top`` of them.

    Without a reranker the fused order stays, and a prompt whose only accepted document is ambiguous gets none.
    """
    if reranker == "none":
        held = candidates.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(W.partitionBy("prompt_id").orderBy("rank"))).where(F.col("rank") <= top)
        n = F.count("*").over(W.partitionBy("prompt_id"))
        return held.withColumn("n", n).where(~((F.col("n") == 1) & F.col("ambiguous"))).drop("n", "ambiguous")
    scored = rerank(candidates.select("prompt_id", "doc_id", "score"), prompts, catalog, depth, reranker, load).where(F.col("score") >= floor)
    return scored.where(F.col("rank") <= top).join(candidates.select("prompt_id", "doc_id", "method"), ["prompt_id", "doc_id"])


def route(prompts: DataFrame, catalog: DataFrame, top: int = 2, mode: str = "hybrid", pool: DataFrame | None = None, max_entries: int = 300, reranker: str = "similarity", load: Callable | None = None, depth: int = DEPTH, lexical: DataFrame | None = None) -> DataFrame:
    """(prompt_id, doc_id, score, rank, method) by mode ``lexical``, ``semantic`` or ``hybrid``.

    prompts: prompt_id, prompt and, but for the lexical mode, embedding (null: no vector); pool: doc_id, embedding. Prompts with a
    vector take the fused and reranked list, or nothing if that accepts nothing; prompts without one fall back on terms.
    ``semantic`` leaves out the exact-name shortcut. reranker and load: see `rerank`. lexical: the terms' list of ``max(top, 2)``
    documents, if the caller has it for several modes.
    """
    if mode not in ("lexical", "semantic", "hybrid"):
        raise ValueError("mode is lexical, semantic or hybrid")
    if mode == "lexical":
        found = lexical_top(prompts, catalog, top) if lexical is None else lexical.where(F.col("rank") <= top)
        return found.select("prompt_id", "doc_id", "score", "rank", F.lit("lexical").alias("method"))
    within = folder(prompts.sparkSession, "route")  # what is read more than once is stored
    prompts = stored(prompts.select("prompt_id", "prompt", "embedding"), "prompts", within)
    asked = prompts.where("embedding is not null").select("prompt_id", "embedding")
    shown = [c for c in ("doc_id", "provider", "name", "description", "activation_tokens") if c in catalog.columns]
    entries = stored(catalog.select(*shown, tx.content_hash(F.col("body")).alias("content_hash")), "entries", within)  # so whole texts are read here and by the reranker only
    exact = exact_name_matches(prompts, entries, max_entries if mode == "hybrid" else -1)
    lexical = lexical_top(prompts, entries, max(top, 2)) if lexical is None else lexical
    semantic = stored(semantic_list(asked, pool, entries, top, depth=depth), "semantic", within)
    candidates = stored(fused_pool(semantic, lexical, max(top, depth)), "candidates", within)
    accepted = stored(accept(candidates, prompts, catalog, top, reranker, load, depth=max(top, depth)), "accepted")
    return decide(exact, accepted, lexical.where(F.col("rank") <= top), asked.select("prompt_id"))
