"""The registered queries over the given tables, each beside the SQL that says the same (None: tested otherwise)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import budget, catalog, context, metrics, retrieval, sampling, sessions, vectors
from ..sources import tables
from ..sources.shared import folder, stored
from ..streaming import sessions as live

_registered: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def keep(f):
        _registered[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _registered.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _registered.items() if s}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.from_documents(_read(spark, sf_dir, "documents"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _read(spark, sf_dir, "conversations").where("role = 'user'")
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), "conv_id", "turn", F.col("text").alias("prompt"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return sessions.indexed(e.select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("long").alias("item"), "ts", "event_id", "event_type", "value"))


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as grades of one task a language: 0 if toxic, else 1 or 3."""
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + 2 * F.col("quality")).cast("double")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    return _read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("lang").alias("task_id"), "doc_id", grade.alias("relevance"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages as catalog entries: provider and name come from the path."""
    path = F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+$", "")
    return _read(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.regexp_extract("url", r"://[^/]*/([a-z]+)/", 1).alias("provider"), F.regexp_extract("url", r"/(\d+)[^/]*/?$", 1).alias("name"))


# SQL text for the same expressions -------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_est = lambda t: f"(CASE WHEN length(coalesce({t}, '')) > 0 THEN greatest(1, ceil(len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]')) * 1.28::DOUBLE)::BIGINT) ELSE 0 END)::BIGINT"
_tok = lambda t: f"list_transform(list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '{tx.SUFFIXES}', '') ELSE w END)"
_wrd = lambda t: f"list_distinct(list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT starts_with(w, '_')))"
_lines = lambda t: f"list_distinct(list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(regexp_replace(lower(trim(x)), '[`*_#>-]', '', 'g'), '\\s+', ' ', 'g')), lambda x: length(x) >= 36))"
_rank = lambda seed, key: f"sha256('{seed}' || chr(0) || {key}::VARCHAR)"

_CAT = f"""d0 AS (SELECT doc_id, lang AS provider, source, substr(text, 1, 320) AS description, text AS body FROM documents),
d1 AS (SELECT *, array_to_string(list_slice({_tok("description")}, 1, 2), '-') AS name FROM d0),
cat AS (SELECT *, {_est("name || ' ' || description")} AS activation_tokens, {_est("body")} AS full_tokens FROM d1)"""
_PROMPTS = "prompts AS (SELECT conv_id * 1000 + turn AS prompt_id, conv_id, turn, text AS prompt FROM conversations WHERE role = 'user')"
_LEX = f"""q AS (SELECT prompt_id, unnest(list_distinct({_tok("prompt")})) AS term FROM prompts),
t AS (SELECT doc_id, list_distinct({_tok("name")}) AS n, list_distinct({_tok("description")}) AS d FROM cat),
tt AS (SELECT doc_id, n, d, unnest(list_distinct(list_concat(n, d))) AS term FROM t),
hits AS (SELECT prompt_id, doc_id, term, CASE WHEN list_contains(n, term) THEN 6 ELSE 0 END + CASE WHEN list_contains(d, term) THEN 2 ELSE 0 END AS weight FROM q JOIN tt USING (term)
         UNION ALL SELECT prompt_id, doc_id, NULL, 12 FROM prompts JOIN cat ON cat.name <> '' AND contains(lower(prompt), lower(cat.name)) WHERE prompt_id IN (SELECT prompt_id FROM q)),
lex AS MATERIALIZED (SELECT prompt_id, doc_id, sum(weight)::DOUBLE AS score, coalesce(array_to_string(list_sort(list(DISTINCT term) FILTER (WHERE term IS NOT NULL)), ' '), '') AS matches FROM hits GROUP BY ALL),
lextop AS MATERIALIZED (SELECT * FROM (SELECT lex.*, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, activation_tokens, doc_id) AS rank FROM lex JOIN cat USING (doc_id) WHERE score >= 2))"""
_LOG = "log AS (SELECT user_id AS session, (props->>'$.k')::BIGINT AS item, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS now FROM events)"
_FEAT = "feat AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first_use, item) AS insert_seq FROM (SELECT session, item, min(now) AS first_use, max(now) AS last_use, count(*) - 1 AS hits FROM log GROUP BY ALL))"
_QRELS = "qrels AS (SELECT lang AS task_id, doc_id, (CASE WHEN toxic = 1 THEN 0 ELSE 1 + 2 * quality END)::DOUBLE AS relevance FROM labels JOIN documents USING (doc_id))"
_PAGES = "pg AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS provider, regexp_extract(url, '/(\\d+)[^/]*/?$', 1) AS name FROM pages)"
_SIM = "round(list_dot_product(qv.e::DOUBLE[], pv.e::DOUBLE[]) / (sqrt(list_dot_product(qv.e::DOUBLE[], qv.e::DOUBLE[])) * sqrt(list_dot_product(pv.e::DOUBLE[], pv.e::DOUBLE[]))), 9)"
_SEM = f"""pv AS (SELECT vec_id AS doc_id, label, embedding AS e FROM embeddings),
sims AS MATERIALIZED (SELECT prompt_id, doc_id, {_SIM} AS score FROM qv, pv),
sem AS (SELECT prompt_id, doc_id, score, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id) AS rank FROM sims)"""
_VEC = f"qv AS (SELECT vec_id AS prompt_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), {_SEM}"
_QV = """near AS (SELECT prompt_id, unnest(range(conv_id, conv_id + 1 + conv_id % 8)) AS vec_id FROM prompts WHERE prompt_id % 100 = 0 AND conv_id IN (SELECT vec_id FROM embeddings)),
parts AS (SELECT prompt_id, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS x FROM near JOIN embeddings USING (vec_id)),
qv AS MATERIALIZED (SELECT prompt_id, list(x ORDER BY j) AS e FROM (SELECT prompt_id, j, sum(x) AS x FROM parts GROUP BY ALL) GROUP BY prompt_id)"""
_PVEC = f"{_QV}, {_SEM}".replace("FROM embeddings),", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),")
_TITLED = _CAT.replace("'-') AS name FROM d0", "'-') AS old, regexp_extract(description, '^\\p{L}+ \\p{L}+', 0) AS name FROM d0").replace(_est("name || ' ' || description"), _est("old || ' ' || description"))
_EXACT = """said AS (SELECT prompt_id, trim(regexp_replace(lower(prompt), '[\\s_-]+', ' ', 'g')) AS p FROM prompts),
own AS (SELECT doc_id, trim(regexp_replace(lower(name), '[\\s_-]+', ' ', 'g')) AS n FROM cat WHERE length(regexp_replace(name, '[-_\\s]', '', 'g')) >= 4),
held AS MATERIALIZED (SELECT prompt_id, doc_id, p, n FROM said JOIN own ON contains(p, n)), met AS (SELECT prompt_id, doc_id FROM held WHERE regexp_matches(p, '(^|[^\\p{L}\\p{N}])' || n || '($|[^\\p{L}\\p{N}])')),
ex AS (SELECT prompt_id, min(doc_id) AS doc_id FROM met GROUP BY prompt_id HAVING count(*) = 1)"""
_ACCEPT = f"""texts AS MATERIALIZED (SELECT sims.*, row_number() OVER (PARTITION BY prompt_id, sha256(body) ORDER BY score DESC, doc_id) AS copy FROM sims JOIN cat USING (doc_id) WHERE score >= 0.42),
semlist AS MATERIALIZED (SELECT prompt_id, doc_id, score, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id) AS rank FROM texts WHERE copy = 1 QUALIFY rank <= 20),
places AS (SELECT prompt_id, doc_id, rank FROM semlist UNION ALL SELECT prompt_id, doc_id, rank FROM lextop WHERE rank <= 2 AND prompt_id IN (SELECT prompt_id FROM semlist)),
fused AS MATERIALIZED (SELECT prompt_id, doc_id, row_number() OVER (PARTITION BY prompt_id ORDER BY rrf DESC, doc_id) AS place FROM (SELECT prompt_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM places GROUP BY ALL) QUALIFY place <= 20),
based AS MATERIALIZED (SELECT prompt_id, doc_id, place, coalesce(s.score, 0) AS score, CASE WHEN s.doc_id IS NULL THEN 'lexical' ELSE 'semantic' END AS method, coalesce(s.rank = 1 AND s.score - n.score < 0.04, false) AS close
    FROM fused LEFT JOIN semlist s USING (prompt_id, doc_id) LEFT JOIN (SELECT prompt_id, score FROM semlist WHERE rank = 2) n USING (prompt_id)),
judged AS (SELECT based.*, list_distinct({_tok("prompt")}) AS q, list_distinct({_tok("body")}) AS d FROM based JOIN prompts USING (prompt_id) JOIN cat USING (doc_id)),
lifted AS (SELECT prompt_id, doc_id, method, round(greatest(score, 0.85::DOUBLE * score + 0.15::DOUBLE * CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q)::DOUBLE ELSE 0 END), 9) AS score FROM judged),
accepted AS MATERIALIZED (SELECT prompt_id, doc_id, score, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id) AS rank, method FROM lifted WHERE score >= 0.42 QUALIFY rank <= 2)"""
_DECIDE = _ACCEPT + """,
u AS MATERIALIZED (SELECT prompt_id, doc_id, 1.0::DOUBLE AS score, 1 AS rank, 'exact' AS method, 0 AS p FROM ex
      UNION ALL SELECT prompt_id, doc_id, score, rank, method, 1 FROM accepted
      UNION ALL SELECT prompt_id, doc_id, least(0.6, score / 20), rank, 'lexical', 2 FROM lextop WHERE rank <= 2 AND prompt_id NOT IN (SELECT prompt_id FROM qv)),
decided AS (SELECT prompt_id, doc_id, score, rank, method FROM u WHERE p = (SELECT min(p) FROM u v WHERE v.prompt_id = u.prompt_id))"""
_BLEND = f"""bs AS (SELECT prompt_id, doc_id, least(1, score / 20) AS score FROM lextop WHERE rank <= 5),
bo AS (SELECT bs.*, list_distinct({_tok("prompt")}) AS q, list_distinct({_tok("body")}) AS d FROM bs JOIN prompts USING (prompt_id) JOIN cat USING (doc_id)),
bl AS (SELECT prompt_id, doc_id, round(greatest(score, 0.85::DOUBLE * score + 0.15::DOUBLE * CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q)::DOUBLE ELSE 0 END), 9) AS score FROM bo),
blend AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id) AS rank FROM bl)"""
_BASKETS = "b AS (SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem)"


# Retrieval --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_CAT}, {_PROMPTS}, {_LEX} SELECT prompt_id, doc_id, score, matches, rank FROM lextop WHERE rank <= 2")
def lexical_top2(spark, sf_dir):
    return retrieval.lexical_top(_prompts(spark, sf_dir), _catalog(spark, sf_dir), 2)


_BODY_HITS = f"""q AS (SELECT prompt_id, unnest(list_distinct({_tok("prompt")})) AS term FROM prompts),
tt AS (SELECT doc_id, unnest(list_distinct({_tok("name")})) AS term, 6 AS weight FROM cat UNION ALL SELECT doc_id, unnest(list_distinct({_tok("description")})), 2 FROM cat UNION ALL SELECT doc_id, unnest(list_distinct({_tok("body")})), 1 FROM cat),
hits AS (SELECT prompt_id, doc_id, term, weight FROM q JOIN tt USING (term) UNION ALL SELECT prompt_id, doc_id, NULL, 12 FROM prompts JOIN cat ON cat.name <> '' AND contains(lower(prompt), lower(cat.name)) WHERE prompt_id IN (SELECT prompt_id FROM q)),
lex AS (SELECT prompt_id, doc_id, sum(weight)::DOUBLE AS score, coalesce(array_to_string(list_sort(list(DISTINCT term) FILTER (WHERE term IS NOT NULL)), ' '), '') AS matches FROM hits GROUP BY ALL)"""


@query(f"""WITH {_CAT}, {_PROMPTS}, {_BODY_HITS}
    SELECT * FROM (SELECT lex.*, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, activation_tokens, doc_id) AS rank FROM lex JOIN cat USING (doc_id) WHERE score >= 2) WHERE rank <= 2""")
def body_search(spark, sf_dir):
    """Whole texts: the terms of the bodies count 1 each."""
    return retrieval.lexical_top(_prompts(spark, sf_dir), _catalog(spark, sf_dir), 2, body_weight=1)


def _vector_list(spark, sf_dir, top):
    """Every vector whose id is divisible by 100 against all vectors, itself included."""
    v = _read(spark, sf_dir, "embeddings")
    return retrieval.vector_top(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("prompt_id"), "embedding"), v.select(F.col("vec_id").alias("doc_id"), "embedding"), top)


def _vectored(spark, sf_dir):
    """Prompts; those whose id is divisible by 100 (first turns) have the sum of one to eight vectors, the conversation's and those after it: from one clear answer over near ties to none over the floor."""
    v, prompts = _read(spark, sf_dir, "embeddings"), _prompts(spark, sf_dir)
    first = prompts.where("prompt_id % 100 = 0").join(v.select(F.col("vec_id").alias("conv_id")), "conv_id", "left_semi")
    near = first.select("prompt_id", F.explode(F.sequence("conv_id", F.col("conv_id") + F.col("conv_id") % 8)).alias("vec_id")).join(v.select("vec_id", "embedding"), "vec_id")
    parts = near.select("prompt_id", F.posexplode("embedding").alias("j", "x")).groupBy("prompt_id", "j").agg(F.sum(F.col("x").cast("double")).alias("x"))
    sums = parts.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda y: y["x"]).alias("embedding"))
    return prompts.join(sums, "prompt_id", "left")


def _pool(spark, sf_dir):
    """The vectors of the catalog's documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs, "doc_id", "left_semi")


def _titled(spark, sf_dir):
    """The catalog, named by the first two words of the descriptions."""
    return _catalog(spark, sf_dir).withColumn("name", F.regexp_extract("description", r"^\p{L}+ \p{L}+", 0))


@query(f"WITH {_VEC} SELECT prompt_id, doc_id, round(score, 6) AS score, rank FROM sem WHERE rank <= 10")
def vector_top10(spark, sf_dir):
    return _vector_list(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC} SELECT s.prompt_id, s.doc_id, round(s.score, 6) AS score, coalesce(s.score - n.score < 0.04, false) AS ambiguous FROM sem s LEFT JOIN sem n ON n.prompt_id = s.prompt_id AND n.rank = 2 WHERE s.rank = 1")
def semantic_ambiguity(spark, sf_dir):
    return retrieval.ambiguity(_vector_list(spark, sf_dir, 2)).select("prompt_id", "doc_id", F.round("score", 6).alias("score"), "ambiguous")


@query(f"WITH {_VEC} SELECT prompt_id, pv.label::BIGINT AS doc_id, greatest(0, max(round(score, 6))) AS score FROM sem JOIN pv USING (doc_id) WHERE rank <= 10 GROUP BY ALL")
def chunk_max_pool(spark, sf_dir):
    """The labels of vectors as documents, vectors as their chunks."""
    v = _read(spark, sf_dir, "embeddings")
    labels = v.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("label"))
    found = vector_top10(spark, sf_dir).join(labels, "doc_id").select("prompt_id", F.col("label").alias("doc_id"), "score")
    return retrieval.max_pool(found)


@query(f"""WITH {_CAT}, {_PROMPTS}, {_LEX}, {_PVEC},
    both_lists AS (SELECT prompt_id, doc_id, rank FROM lextop WHERE rank <= 5 UNION ALL SELECT prompt_id, doc_id, rank FROM sem WHERE rank <= 5),
    rrf AS (SELECT prompt_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM both_lists GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id) AS rank FROM rrf) WHERE rank <= 3""")
def rank_fusion(spark, sf_dir):
    """The lexical list fused with the vector list of the prompts that have a vector."""
    prompts = _vectored(spark, sf_dir)
    asked = prompts.where("embedding is not null").select("prompt_id", "embedding")
    return retrieval.fuse(retrieval.lexical_top(prompts, _catalog(spark, sf_dir), 5), retrieval.vector_top(asked, _pool(spark, sf_dir), 5), top=3)


#: Of the five candidates those that load; not a ``<=``, which would be a second, smaller top-k under the shuffle, so the first could not be reused.
_LOADED = "rank IN (1, 2) AND score >= 10"


def _five(spark, sf_dir):
    return retrieval.lexical_top(_prompts(spark, sf_dir), _catalog(spark, sf_dir), 5)


def _scaled(found):
    return found.select("prompt_id", "doc_id", F.least(F.lit(1.0), F.col("score") / 20).alias("score"))


def _blended(spark, sf_dir, found):
    return retrieval.rerank(_scaled(found), _prompts(spark, sf_dir), _catalog(spark, sf_dir), 2, "similarity")


@query(f"WITH {_CAT}, {_PROMPTS}, {_LEX}, {_BLEND} SELECT prompt_id, doc_id, score, rank FROM blend WHERE rank <= 2")
def rerank_blend(spark, sf_dir):
    return _blended(spark, sf_dir, _five(spark, sf_dir))


@query(f"""WITH {_CAT}, {_PROMPTS}, {_LEX}, {_BLEND}, plain AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, doc_id) AS rank FROM bs)
    SELECT 'none' AS mode, prompt_id, doc_id, score, rank FROM plain WHERE rank <= 3 UNION ALL SELECT 'similarity', prompt_id, doc_id, score, rank FROM blend WHERE rank <= 3""")
def rerank_modes(spark, sf_dir):
    held, prompts, cat = _scaled(_five(spark, sf_dir)), _prompts(spark, sf_dir), _catalog(spark, sf_dir)
    one = lambda mode: retrieval.rerank(held, prompts, cat, 3, mode).select(F.lit(mode).alias("mode"), "prompt_id", "doc_id", "score", "rank")
    return one("none").unionByName(one("similarity"))


@query("""WITH
    said AS (SELECT c_custkey AS prompt_id, trim(regexp_replace(lower('about ' || c_name || ' now'), '[\\s_-]+', ' ', 'g')) AS prompt FROM customer),
    own AS (SELECT c_custkey AS doc_id, trim(regexp_replace(lower(c_name), '[\\s_-]+', ' ', 'g')) AS name FROM customer),
    clean AS (SELECT prompt_id, ' ' || regexp_replace(prompt, '[^a-z0-9]', ' ', 'g') || ' ' AS prompt FROM said), names AS (SELECT doc_id, ' ' || regexp_replace(name, '[^a-z0-9]', ' ', 'g') || ' ' AS name FROM own),
    m AS (SELECT prompt_id, doc_id FROM clean JOIN names ON contains(prompt, name))
    SELECT prompt_id, min(doc_id) AS doc_id FROM m GROUP BY prompt_id HAVING count(*) = 1""")
def exact_name(spark, sf_dir):
    """Each customer is named in a prompt; the catalog is the customers."""
    c = _read(spark, sf_dir, "customer")
    said = c.select(F.col("c_custkey").alias("prompt_id"), F.concat(F.lit("about "), "c_name", F.lit(" now")).alias("prompt"))
    return retrieval.exact_name_matches(said, c.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name")), max_entries=1 << 40)


_HYBRID = f"{_TITLED}, {_PROMPTS}, {_LEX}, {_PVEC}, {_EXACT}, {_DECIDE}"


@query(f"WITH {_HYBRID} SELECT prompt_id, doc_id, round(score, 6) AS score, rank, method FROM decided")
def hybrid_decision(spark, sf_dir):
    """Exact names, vectors and terms of the same prompts."""
    found = retrieval.route(_vectored(spark, sf_dir), _titled(spark, sf_dir), 2, "hybrid", _pool(spark, sf_dir), max_entries=1 << 40)
    return found.select("prompt_id", "doc_id", F.round("score", 6).alias("score"), "rank", "method")


@query(f"""WITH {_TITLED}, {_PROMPTS}, {_LEX}, {_PVEC}, ex AS (SELECT 0 AS prompt_id, 0 AS doc_id WHERE false), {_DECIDE}
    SELECT 'lexical' AS mode, prompt_id, doc_id, score, rank, 'lexical' AS method FROM lextop WHERE rank <= 2 UNION ALL SELECT 'semantic', prompt_id, doc_id, round(score, 6), rank, method FROM decided""")
def routing_modes(spark, sf_dir):
    prompts, cat, pool = _vectored(spark, sf_dir), _titled(spark, sf_dir), _pool(spark, sf_dir)
    lexical = retrieval.lexical_top(prompts, cat, 2)
    one = lambda mode: retrieval.route(prompts, cat, 2, mode, pool, lexical=lexical).select(F.lit(mode).alias("mode"), "prompt_id", "doc_id", F.round("score", 6).alias("score"), "rank", "method")
    return one("lexical").unionByName(one("semantic"))


@query(f"""WITH {_TITLED}, {_PROMPTS}, {_LEX}, {_PVEC}, {_ACCEPT}
    SELECT 2 AS top, prompt_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY prompt_id ORDER BY place) AS rank FROM based WHERE score >= 0.42 QUALIFY rank <= 2
    UNION ALL SELECT 1, prompt_id, doc_id, round(score, 6), 1 FROM (SELECT * FROM based WHERE score >= 0.42 QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY place) = 1) WHERE NOT close""")
def unranked_decision(spark, sf_dir):
    """Without a reranker: the fused order stays; asked for one document, a near tie gives none, asked for two it gives both."""
    prompts, cat, pool = _vectored(spark, sf_dir), _titled(spark, sf_dir), _pool(spark, sf_dir)
    asked, lexical = prompts.where("embedding is not null").select("prompt_id", "embedding"), retrieval.lexical_top(prompts, cat, 2)

    def one(top):
        candidates = retrieval.fused_pool(stored(retrieval.semantic_list(asked, pool, cat, top), "semantic"), lexical)
        return retrieval.accept(candidates, prompts, cat, top, "none").select(F.lit(top).alias("top"), "prompt_id", "doc_id", F.round("score", 6).alias("score"), "rank")

    return one(2).unionByName(one(1))


@query(f"WITH {_HYBRID}, d AS (SELECT DISTINCT prompt_id, method FROM decided) SELECT coalesce(method, 'none') AS method, count(*) AS n FROM prompts LEFT JOIN d USING (prompt_id) GROUP BY 1")
def method_histogram(spark, sf_dir):
    methods = hybrid_decision(spark, sf_dir).groupBy("prompt_id").agg(F.collect_set("method").alias("methods"))
    return metrics.method_histogram(_prompts(spark, sf_dir).select("prompt_id").join(methods, "prompt_id", "left"))


@query(f"""WITH {_CAT}, {_PROMPTS}, {_LEX} SELECT prompt_id, doc_id FROM lextop WHERE rank <= 5 AND (prompt_id, doc_id) NOT IN (SELECT (prompt_id, doc_id) FROM lextop WHERE rank <= 2)""")
def lexical_only_extras(spark, sf_dir):
    held = _five(spark, sf_dir)
    return held.join(held.where("rank <= 2").select("prompt_id", "doc_id"), ["prompt_id", "doc_id"], "left_anti").select("prompt_id", "doc_id")


@query(f"""WITH {_CAT}, {_PROMPTS}, {_LEX} SELECT prompt_id, doc_id, rank, score >= 20 AS admitted FROM lextop WHERE rank <= 5""")
def two_floor_search(spark, sf_dir):
    """Retrieved with the relaxed floor and depth, admitted with the strict one."""
    return _five(spark, sf_dir).select("prompt_id", "doc_id", "rank", (F.col("score") >= 20).alias("admitted"))


# Text and catalog -------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, {_est("text")} AS tokens, len({_tok("text")}) AS terms, len({_wrd("text")}) AS words, len(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS raw_terms FROM documents""")
def text_measures(spark, sf_dir):
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(t).alias("tokens"), F.size(tx.tokenize(t)).alias("terms"), F.size(tx.sampler_words(t)).alias("words"), F.size(tx.raw_terms(t)).alias("raw_terms"))


@query(f"""WITH {_CAT} SELECT doc_id, sha256(body) AS content_hash, {_rank("s", "doc_id")} AS stable_rank, 300 + ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 2201 AS cost,
    substr(sha256(lower(trim(body))), 1, 32) AS prompt_key, sha256(provider || chr(0) || doc_id::VARCHAR) AS session_key, ('0x' || substr({_rank("s", "doc_id")}, 1, 12))::BIGINT AS stable_rank48,
    provider || '-' || coalesce(nullif(substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 48), ''), 'skill') || '-' || substr(sha256(source), 1, 10) AS stable_id,
    coalesce(nullif(substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 48), ''), 'skill') AS slug,
    name || ' | ' || substr(description, 1, 500) || ' | ' || substr(body, 1, 8000) AS document_text, 'query: ' || substr(body, 1, 2000) AS query_text,
    replace(replace(replace(replace(name || '<&">', '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM cat""")
def text_keys(spark, sf_dir):
    name, body = F.col("name"), F.col("body")
    return _catalog(spark, sf_dir).select(
        "doc_id", tx.content_hash(body).alias("content_hash"), tx.stable_rank("s", F.col("doc_id")).alias("stable_rank"), tx.synthetic_cost(F.col("doc_id")).alias("cost"),
        tx.stable_rank48("s", F.col("doc_id")).alias("stable_rank48"), tx.stable_id(F.col("provider"), name, F.col("source")).alias("stable_id"), tx.prompt_key(body).alias("prompt_key"), tx.session_key(F.col("provider"), F.col("doc_id")).alias("session_key"), tx.slug(name).alias("slug"),
        tx.document_text(name, F.col("description"), body).alias("document_text"), tx.query_text(body, "query: ").alias("query_text"), tx.escape_attr(F.concat(name, F.lit('<&">'))).alias("escaped"),
    )


@query(f"""WITH u AS (SELECT c.conv_id, c.turn, list_distinct({_tok("c.text")}) AS q, list_distinct({_tok("a.text")}) AS d, {_wrd("c.text")} AS wq, {_wrd("a.text")} AS wd FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user')
    SELECT conv_id, turn, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q)::DOUBLE ELSE 0 END, 9) AS body_overlap, round(len(list_intersect(wq, wd)) / greatest(1, len(wq))::DOUBLE, 9) AS query_overlap FROM u""")
def answer_overlap(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    held = c.where("role = 'user'").join(a, ["conv_id", "turn"])
    return held.select("conv_id", "turn", F.round(tx.overlap(tx.tokenize(F.col("text")), tx.tokenize(F.col("answer"))), 9).alias("body_overlap"), F.round(tx.overlap(tx.sampler_words(F.col("text")), tx.sampler_words(F.col("answer"))), 9).alias("query_overlap"))


@query(f"""WITH {_CAT}, p AS (SELECT unnest(['de', 'en', 'all', 'other']) AS provider), named AS (SELECT * REPLACE (CASE WHEN provider IN ('de', 'en', 'all') THEN provider ELSE 'other' END AS provider) FROM cat)
    SELECT p.provider, count(doc_id) AS n, coalesce(sum(activation_tokens), 0)::BIGINT AS catalog_tokens, coalesce(sum(full_tokens), 0)::BIGINT AS full_tokens,
    arg_max(doc_id, full_tokens * 1000000000 - doc_id) AS largest_doc, max(full_tokens) AS largest_tokens FROM p LEFT JOIN named USING (provider) GROUP BY p.provider""")
def provider_profile(spark, sf_dir):
    return catalog.provider_profile(_catalog(spark, sf_dir), ["de", "en", "all"])


@query(f"""WITH {_CAT}, l AS (SELECT * FROM cat WHERE doc_id IN (SELECT min(doc_id) FROM cat GROUP BY sha256(body)))
    SELECT count(*) AS files, sum(activation_tokens)::BIGINT AS files_catalog_tokens, sum(full_tokens)::BIGINT AS files_full_tokens, (SELECT count(*) FROM l) AS entries,
    (SELECT sum(activation_tokens) FROM l)::BIGINT AS entries_catalog_tokens, (SELECT sum(full_tokens) FROM l)::BIGINT AS entries_full_tokens FROM cat""")
def catalog_profile(spark, sf_dir):
    cat = _catalog(spark, sf_dir)
    return catalog.catalog_profile(cat, cat.join(catalog.content_dedup(cat).select(F.col("kept").alias("doc_id")), "doc_id", "left_semi"))


@query(f"""WITH l AS (SELECT doc_id, unnest({_lines("text")}) AS line FROM documents), c AS (SELECT line, count(*) AS n FROM l GROUP BY line HAVING count(*) > 1)
    SELECT count(*) AS repeated_lines, coalesce(sum({_est("line")} * (n - 1)), 0)::BIGINT AS duplicate_tokens FROM c""")
def repeated_lines(spark, sf_dir):
    return catalog.repeated_line_tokens(_catalog(spark, sf_dir))


@query(f"""WITH l AS (SELECT doc_id, unnest({_lines("text")}) AS line FROM documents), c AS (SELECT line FROM l GROUP BY line HAVING count(*) > 1),
    s AS (SELECT doc_id, sum({_est("line")}) AS t FROM l WHERE line IN (SELECT line FROM c) GROUP BY doc_id)
    SELECT doc_id, coalesce(t, 0)::BIGINT AS repeated_tokens FROM documents LEFT JOIN s USING (doc_id)""")
def repeated_tokens(spark, sf_dir):
    return catalog.repeated_tokens_by_document(_catalog(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT page_id, path, provider, name FROM (SELECT *, row_number() OVER (PARTITION BY provider, name ORDER BY length(path), path, page_id) AS n FROM pg) WHERE n = 1")
def logical_dedup(spark, sf_dir):
    return catalog.logical_dedup(_pages(spark, sf_dir), "page_id")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return catalog.content_dedup(_catalog(spark, sf_dir))


@query(f"""WITH {_PAGES}, m AS (SELECT page_id, provider, name, CASE WHEN page_id % 3 = 0 THEN '.cursor/' || path ELSE path END AS path FROM pg),
    r AS (SELECT *, list_contains(string_split(path, '/'), '.cursor') AS mirror FROM m),
    b AS (SELECT *, first_value(path) OVER (PARTITION BY provider, name ORDER BY CASE WHEN mirror THEN 1000000 ELSE 0 END + length(path), path) AS best FROM r)
    SELECT page_id, path, CASE WHEN path <> best AND mirror THEN 'mirror-of-kept-entry' END AS reason FROM b""")
def name_dedup(spark, sf_dir):
    """Every third page stands in a mirror folder."""
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(".cursor/"), "path")).otherwise(F.col("path"))
    return catalog.name_dedup(_pages(spark, sf_dir).withColumn("path", path)).select("page_id", "path", "reason")


@query(f"""WITH {_PAGES}, m AS (SELECT page_id, CASE page_id % 8 WHEN 2 THEN '.system/' WHEN 4 THEN 'x/plugins/cache/' WHEN 6 THEN '.state/' ELSE '' END || path || CASE WHEN page_id % 2 = 0 THEN '.md' ELSE '' END AS path FROM pg WHERE provider = 'en')
    SELECT page_id, CASE WHEN NOT (ends_with(path, '.md') OR ends_with(path, '.html')) THEN 'unsupported-kind' WHEN contains('/' || path, '/.system/') THEN 'system-path' WHEN contains(path, '/plugins/cache/') THEN 'plugin-cache' WHEN contains('/' || path, '/.state/') THEN 'own-state' END AS reason FROM m""")
def eligibility(spark, sf_dir):
    """Pages with an even id are Markdown files, three quarters of them in folders that are not taken."""
    folder = F.when(F.col("page_id") % 8 == 2, ".system/").when(F.col("page_id") % 8 == 4, "x/plugins/cache/").when(F.col("page_id") % 8 == 6, ".state/").otherwise("")
    pages = _pages(spark, sf_dir).withColumn("path", F.concat(folder, "path", F.when(F.col("page_id") % 2 == 0, ".md").otherwise("")))
    return catalog.eligible(pages, "en").select("page_id", catalog.rejection_reason(F.col("path")).alias("reason"))


@query(f"""WITH {_CAT}, refs AS (SELECT DISTINCT name AS ref FROM cat WHERE doc_id % 2 = 0 UNION SELECT doc_id::VARCHAR FROM cat UNION SELECT DISTINCT source FROM cat),
    first AS (SELECT name, min(doc_id) AS doc_id FROM cat GROUP BY name)
    SELECT ref, CASE WHEN c.doc_id IS NOT NULL THEN 'id' WHEN f.doc_id IS NOT NULL THEN 'name' ELSE 'unknown' END AS matched_by, coalesce(c.doc_id, f.doc_id) AS doc_id
    FROM refs LEFT JOIN cat c ON c.doc_id::VARCHAR = ref LEFT JOIN first f ON f.name = ref""")
def reference_resolution(spark, sf_dir):
    cat = _catalog(spark, sf_dir)
    refs = cat.where("doc_id % 2 = 0").select(F.col("name").alias("ref")).union(cat.select(F.col("doc_id").cast("string"))).union(cat.select("source"))
    return catalog.resolve_references(refs, cat)


@query(f"WITH {_PAGES}, u AS (SELECT DISTINCT path FROM pg) SELECT path FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE starts_with(u.path, v.path || '/'))")
def outermost_paths(spark, sf_dir):
    return catalog.outermost_paths(_pages(spark, sf_dir).select("path"))


@query(f"WITH {_PAGES}, r AS (SELECT DISTINCT regexp_extract(path, '^[^/]*', 0) AS root FROM pg UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/en', 0) FROM pg) SELECT path, arg_max(root, length(root)) AS root FROM (SELECT DISTINCT path FROM pg) u JOIN r ON path = root OR starts_with(path, root || '/') WHERE root <> '' GROUP BY path")
def longest_root(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    roots = pages.select(F.regexp_extract("path", "^[^/]*", 0).alias("root")).union(pages.select(F.regexp_extract("path", "^[^/]*/en", 0))).where("root <> ''")
    return catalog.longest_root(pages.select("path").distinct(), roots)


_KNOWN = ["tion", "keit", "ción", "ment", "the ", "never said"]


@query(f"""WITH topics AS (SELECT unnest([{", ".join(f"'{t}'" for t in _KNOWN)}]) AS topic), {_CAT} SELECT topic, count(*) AS n FROM topics JOIN cat ON contains(lower(name || ' ' || description), topic) GROUP BY topic HAVING count(*) >= 2""")
def topic_overlap(spark, sf_dir):
    """Topics that occur in the invented prose, in place of the usual ones."""
    return catalog.topic_overlap(_catalog(spark, sf_dir), _KNOWN)


@query(f"""WITH {_CAT}, {_PROMPTS}, skills AS (SELECT name, CASE WHEN doc_id % 9 = 0 THEN '' ELSE description END AS description FROM cat),
    sess AS (SELECT DISTINCT conv_id AS session FROM conversations UNION ALL SELECT conv_id FROM conversations WHERE conv_id % 7 = 0 AND turn = 0 UNION ALL SELECT 1000000 + min(conv_id) FROM conversations),
    t AS (SELECT conv_id AS session, turn AS position, CASE WHEN turn = 4 THEN ' ' ELSE prompt END AS prompt, ['none-' || turn::VARCHAR, (SELECT min(name) FROM skills)] AS names FROM prompts)
    SELECT coalesce(name, '') AS subject, 'skill-without-text' AS rule FROM skills WHERE trim(coalesce(name, '')) = '' OR trim(description) = ''
    UNION ALL SELECT name, 'repeated-skill' FROM skills GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT session::VARCHAR, 'repeated-session' FROM sess GROUP BY session HAVING count(*) > 1
    UNION ALL SELECT DISTINCT session::VARCHAR, 'session-without-turns' FROM sess WHERE session NOT IN (SELECT session FROM t)
    UNION ALL SELECT session::VARCHAR || '/' || position::VARCHAR, 'turn-without-prompt' FROM t WHERE trim(prompt) = ''
    UNION ALL SELECT DISTINCT session::VARCHAR || '/' || position::VARCHAR, 'unknown-reference' FROM (SELECT session, position, unnest(names) AS n FROM t) WHERE n NOT IN (SELECT name FROM skills)""")
def suite_violations(spark, sf_dir):
    """A suite of the catalog and the conversations with faults put in by rule."""
    skills = _catalog(spark, sf_dir).select("name", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("description")).alias("description"))
    c, prompts = _read(spark, sf_dir, "conversations"), _prompts(spark, sf_dir)
    suite = c.select(F.col("conv_id").alias("session")).distinct().union(c.where("conv_id % 7 = 0 and turn = 0").select("conv_id")).union(c.agg(F.min("conv_id") + 1_000_000))
    first = skills.agg(F.min("name").alias("first"))
    turns = prompts.join(F.broadcast(first), F.lit(True)).select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), F.when(F.col("turn") == 4, " ").otherwise(F.col("prompt")).alias("prompt"), F.array(F.concat(F.lit("none-"), F.col("turn").cast("string")), F.col("first")).alias("names"))
    return catalog.suite_violations(skills, suite, turns)


@query(f"""WITH {_PROMPTS}, c AS (SELECT prompt_id AS case_id, CASE WHEN turn = 6 THEN ' ' ELSE prompt END AS prompt, CASE WHEN turn = 2 THEN [conv_id, conv_id + turn, conv_id + 1] ELSE [conv_id, conv_id + turn] END AS expected, [turn, 999999999] AS forbidden FROM prompts)
    SELECT case_id, 'too-many-expected' AS rule FROM c WHERE len(expected) > 2 UNION ALL SELECT case_id, 'expected-and-forbidden' AS rule FROM c WHERE list_has_any(expected, forbidden)
    UNION ALL SELECT DISTINCT case_id, 'unknown-id' FROM (SELECT case_id, unnest(list_concat(expected, forbidden)) AS d FROM c) WHERE d NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT case_id, 'repeated-prompt' FROM (SELECT case_id, row_number() OVER (PARTITION BY lower(trim(prompt)) ORDER BY case_id) AS n FROM c) WHERE n > 1
    UNION ALL SELECT case_id, 'empty-prompt' FROM c WHERE trim(prompt) = ''""")
def case_violations(spark, sf_dir):
    """Prompts as cases: the third turn expects three documents, the seventh says nothing."""
    two = F.array("conv_id", F.col("conv_id") + F.col("turn"))
    expected = F.when(F.col("turn") == 2, F.concat(two, F.array(F.col("conv_id") + 1))).otherwise(two)
    cases = _prompts(spark, sf_dir).select(F.col("prompt_id").alias("case_id"), F.when(F.col("turn") == 6, " ").otherwise(F.col("prompt")).alias("prompt"), expected.alias("expected"), F.array("turn", F.lit(999_999_999).cast("long")).alias("forbidden"))
    return catalog.case_violations(cases, _catalog(spark, sf_dir))


_LANES = ", ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0)::VARCHAR" for i in range(8))


@query(f"""WITH r AS (SELECT sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(text, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(n_chars::VARCHAR, chr(0)))) AS h FROM documents)
    SELECT sha256(concat_ws(',', {_LANES}, count(*)::VARCHAR)) AS fingerprint FROM r""")
def catalog_fingerprint(spark, sf_dir):
    return catalog.fingerprint(_read(spark, sf_dir, "documents"))


# Budgets ----------------------------------------------------------------------------------------------------------------


def _candidates(spark, sf_dir):
    cat = _catalog(spark, sf_dir)
    return retrieval.lexical_top(_prompts(spark, sf_dir), cat, 5).join(cat.select("doc_id", F.col("full_tokens").alias("tokens"), tx.content_hash(F.col("body")).alias("content_hash")), "doc_id")


@query(f"""WITH {_CAT}, {_PROMPTS}, {_LEX}, r AS (SELECT prompt_id, doc_id, rank, activation_tokens AS tokens, sum(activation_tokens) OVER (PARTITION BY prompt_id ORDER BY rank) AS running FROM lextop JOIN cat USING (doc_id) WHERE rank <= 5)
    SELECT prompt_id, doc_id, rank, running::BIGINT AS running FROM r WHERE running <= 400""")
def prefix_budget(spark, sf_dir):
    held = _five(spark, sf_dir).join(_catalog(spark, sf_dir).select("doc_id", F.col("activation_tokens").alias("tokens")), "doc_id")
    return budget.prefix_budget(held, 400).select("prompt_id", "doc_id", "rank", "running")


def _greedy(limit: int, reason: str) -> str:
    return f"""WITH RECURSIVE {_CAT}, {_PROMPTS}, {_LEX},
    c AS MATERIALIZED (SELECT prompt_id, doc_id, rank, full_tokens AS tokens, sha256(body) AS h FROM lextop JOIN cat USING (doc_id) WHERE rank <= 5),
    f AS (SELECT prompt_id, 0::BIGINT AS rank, NULL::BIGINT AS doc_id, 0::BIGINT AS tokens, NULL::VARCHAR AS reason, 0::BIGINT AS used, []::VARCHAR[] AS seen FROM (SELECT DISTINCT prompt_id FROM c)
          UNION ALL SELECT c.prompt_id, c.rank, c.doc_id, c.tokens, {reason}, CASE WHEN {reason} IS NULL THEN f.used + c.tokens ELSE f.used END, CASE WHEN {reason} IS NULL THEN list_append(f.seen, c.h) ELSE f.seen END
          FROM f JOIN c ON c.prompt_id = f.prompt_id AND c.rank = f.rank + 1 WHERE f.used < {limit})
    SELECT prompt_id, rank, doc_id, tokens, reason FROM f WHERE rank > 0"""


@query(_greedy(1500, "CASE WHEN list_contains(f.seen, c.h) THEN 'duplicate-content' WHEN f.used + c.tokens > 1500 THEN 'token-budget' END"))
def greedy_budget(spark, sf_dir):
    return budget.greedy_budget(_candidates(spark, sf_dir), 1500)


@query(_greedy(900, "CASE WHEN f.used + c.tokens > 900 AND len(f.seen) > 0 THEN 'token-budget' END"))
def greedy_budget_forced(spark, sf_dir):
    return budget.greedy_budget(_candidates(spark, sf_dir), 900, force_first=True)


def _notes(spark, sf_dir):
    return _log(spark, sf_dir).select(F.col("item").alias("doc_id"), F.concat_ws(" ", "event_type", F.col("session").cast("string")).alias("note"), F.col("event_id").alias("seq"))


@query(f"WITH {_LOG}, n AS (SELECT item AS doc_id, event_type || ' ' || session::VARCHAR AS note, max(event_id) AS seq FROM log GROUP BY ALL) SELECT doc_id, note, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC, note) AS p FROM n) WHERE p <= 12")
def last_notes(spark, sf_dir):
    return budget.last_notes(_notes(spark, sf_dir))


@query(f"""WITH {_LOG}, n AS (SELECT item AS doc_id, event_type || ' ' || session::VARCHAR AS note, max(event_id) AS seq FROM log GROUP BY ALL),
    t AS (SELECT *, {_est("note")} AS tokens FROM n), r AS (SELECT *, row_number() OVER w AS p, sum(tokens) OVER w AS running FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq DESC))
    SELECT d.doc_id, count(r.doc_id) AS notes, coalesce(string_agg(note, chr(10) ORDER BY seq), '') AS overlay FROM (SELECT DISTINCT item AS doc_id FROM log) d LEFT JOIN r ON r.doc_id = d.doc_id AND (p = 1 OR running <= 20) GROUP BY d.doc_id""")
def overlay_notes(spark, sf_dir):
    """Each item with its newest notes that fit, in their own order."""
    notes = _notes(spark, sf_dir)
    held = notes.groupBy("doc_id", "note").agg(F.max("seq").alias("seq")).withColumn("tokens", tx.estimate_tokens(F.col("note")))
    kept = budget.newest_first_budget(held, 20).groupBy("doc_id").agg(F.count("*").alias("notes"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "note"))), lambda x: x["note"]), "\n").alias("overlay"))
    return notes.select("doc_id").distinct().join(kept, "doc_id", "left").select("doc_id", F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("overlay", F.lit("")).alias("overlay"))


@query(f"""WITH {_CAT}, {_PROMPTS}, {_LEX} SELECT prompt_id, string_agg('<document name="' || replace(replace(replace(replace(name, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') || '" provider="' || provider || '">' || chr(10) || body || chr(10) || '</document>', chr(10) ORDER BY rank) AS context FROM lextop JOIN cat USING (doc_id) WHERE rank <= 2 GROUP BY prompt_id""")
def context_assembly(spark, sf_dir):
    cat = _catalog(spark, sf_dir)
    return budget.assemble(retrieval.lexical_top(_prompts(spark, sf_dir), cat, 2), cat)


def _element(tag: str, inner: str) -> str:
    escaped = lambda c: f"replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"
    return f"""'<{tag} name="' || {escaped("name")} || '" provider="' || {escaped("provider")} || '">' || chr(10) || {inner} || chr(10) || '</{tag}>'"""


@query(f"""WITH {_CAT}, {_PROMPTS}, {_LEX}, ranked AS (SELECT prompt_id, conv_id, turn, doc_id, score, rank FROM lextop JOIN prompts USING (prompt_id) WHERE rank <= 5),
    res AS (SELECT p.prompt_id, f.doc_id, p.turn - max(f.turn) >= 4 AS stale FROM prompts p JOIN ranked f ON f.conv_id = p.conv_id AND f.turn < p.turn AND f.rank = 1 AND f.score >= 10 GROUP BY p.prompt_id, f.doc_id, p.turn),
    sel AS (SELECT prompt_id, doc_id, rank AS place FROM ranked WHERE rank <= 2 AND score >= 10),
    pend AS (SELECT *, {_est("shown")} AS tokens, row_number() OVER (PARTITION BY prompt_id ORDER BY place) AS k FROM (SELECT s.*, name, provider, coalesce(body, '') || chr(10) || chr(10) || 'Source: ' || source AS shown FROM sel s JOIN cat USING (doc_id) ANTI JOIN res USING (prompt_id, doc_id))),
    one AS (SELECT *, lag(tokens) OVER w <= 600 AS had, CASE WHEN lag(tokens) OVER w <= 600 THEN lag(tokens) OVER w ELSE 0 END AS used, lag(shown) OVER w AS other FROM pend WINDOW w AS (PARTITION BY prompt_id ORDER BY place)),
    jud AS (SELECT *, CASE WHEN had AND shown = other THEN 'duplicate-content' WHEN used + tokens > 600 THEN 'token-budget' END AS reason FROM one WHERE used < 600),
    short AS (SELECT r.*, name, provider, description, {_est("description")} AS cost FROM ranked r JOIN cat USING (doc_id)),
    off AS (SELECT * FROM (SELECT s.*, sum(cost) OVER (PARTITION BY prompt_id ORDER BY rank) AS running FROM short s ANTI JOIN sel USING (prompt_id, doc_id) ANTI JOIN res USING (prompt_id, doc_id)) WHERE running <= 150),
    again AS (SELECT s.* FROM short s JOIN sel USING (prompt_id, doc_id) JOIN res USING (prompt_id, doc_id) WHERE stale),
    parts AS (SELECT prompt_id, CASE WHEN reason IS NULL THEN 0 ELSE 3 END AS kind, place, doc_id, reason, tokens, {_element("document", "shown")} AS x FROM jud
        UNION ALL SELECT prompt_id, 1, rank, doc_id, NULL, 0, {_element("document-again", "description")} FROM again
        UNION ALL SELECT prompt_id, 2, rank, doc_id, NULL, 0, {_element("document-available", "description")} FROM off),
    lists AS (SELECT prompt_id, {", ".join(f"string_agg(doc_id::VARCHAR, ' ' ORDER BY place) FILTER (WHERE kind = {k}) AS {n}, string_agg(x, chr(10) ORDER BY place) FILTER (WHERE kind = {k}) AS x{k}" for k, n in enumerate(("loaded", "restated", "offered")))},
        string_agg(reason, ' ' ORDER BY place) AS skipped, sum(tokens) FILTER (WHERE kind = 0) AS tokens FROM parts GROUP BY prompt_id)
    SELECT prompt_id, coalesce(loaded, '') AS loaded, coalesce(restated, '') AS restated, coalesce(offered, '') AS offered, coalesce(skipped, '') AS skipped, coalesce(tokens, 0)::BIGINT AS tokens, concat_ws(chr(10) || chr(10), x0, x1, x2) AS context FROM prompts LEFT JOIN lists USING (prompt_id)""")
def prompt_context(spark, sf_dir):
    """Every user prompt's context. By rule, a document that came first in an earlier turn is resident, and stale after four turns; a document's source is its note."""
    cat, prompts = _catalog(spark, sf_dir), _prompts(spark, sf_dir)
    ranked = stored(retrieval.lexical_top(prompts, cat, 5).join(prompts.select("prompt_id", "conv_id", "turn"), "prompt_id").withColumn("now", F.col("turn")), "ranked")  # read by every part of the plan
    first = ranked.where("rank = 1 and score >= 10").select("conv_id", F.col("turn").alias("before"), "doc_id")
    known = prompts.select("prompt_id", "conv_id", "turn").join(first, "conv_id").where("before < turn").groupBy("prompt_id", "turn", "doc_id").agg(F.max("before").alias("last"))
    known = known.select("prompt_id", "doc_id", (F.col("turn") - F.col("last") >= 4).alias("stale"))
    notes = cat.select("doc_id", F.concat(F.lit("Source: "), "source").alias("overlay"))
    none = spark.createDataFrame([], "prompt_id long, doc_id long, last long, rank int")
    out = context.prompt_context(prompts, ranked, cat, known, none.drop("rank"), none.drop("last"), notes, token_budget=600, load_floor=10, summary_budget=150)
    words = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return out.select("prompt_id", words("loaded"), words("restated"), words("offered"), words("skipped"), "tokens", "context")


_SECTIONS = f"""{_CAT}, p AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}]+')) AS q, regexp_replace(body, '\\n(\\S)', chr(10) || '## \\1', 'g') AS body FROM cat),
    x AS (SELECT *, string_split(body, chr(10) || '## ') AS parts, {_est("body")} AS tokens FROM p),
    y AS (SELECT doc_id, q, parts, {_est("parts[1]")} AS spent FROM x WHERE tokens > 200 AND len(parts) > 2),
    z0 AS (SELECT doc_id, q, spent, parts, len(parts) - 1 AS n, unnest(range(1, len(parts))) AS pos FROM y),
    z AS (SELECT doc_id, q, spent, n, pos, '## ' || parts[pos + 1] AS section FROM z0),
    w AS MATERIALIZED (SELECT doc_id, pos, spent, n, {_est("section")} AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_intersect(q, list_distinct(regexp_extract_all(lower(section), '[\\p{{L}}\\p{{N}}]+')))) DESC, pos) AS place FROM z),
    f AS (SELECT doc_id, 0::BIGINT AS place, spent::BIGINT AS used, []::BIGINT[] AS kept FROM y
          UNION ALL SELECT w.doc_id, w.place, CASE WHEN f.used + w.tokens <= 150 OR len(f.kept) < 1 THEN f.used + w.tokens ELSE f.used END, CASE WHEN f.used + w.tokens <= 150 OR len(f.kept) < 1 THEN list_append(f.kept, w.pos) ELSE f.kept END
          FROM f JOIN w ON w.doc_id = f.doc_id AND w.place = f.place + 1),
    e AS (SELECT doc_id, arg_max(kept, place) AS kept FROM f GROUP BY doc_id),
    cutted AS (SELECT doc_id, len(parts) - 1 - len(kept) AS dropped, array_to_string(list_concat([parts[1]], list_transform(list_sort(kept), lambda k: '## ' || parts[k + 1])), chr(10)) || chr(10) || chr(10) || '[' || (len(parts) - 1 - len(kept))::VARCHAR || ' sections omitted]' AS body FROM e JOIN y USING (doc_id))"""


@query(f"WITH RECURSIVE {_SECTIONS} SELECT p.doc_id, coalesce(CASE WHEN dropped > 0 THEN c.body END, p.body) AS body, coalesce(dropped, 0) AS dropped FROM p LEFT JOIN cutted c USING (doc_id)")
def section_selection(spark, sf_dir):
    """Each line of a text as a section (a heading mark is put before it); a document's description as its prompt."""
    body = F.regexp_replace("body", "\n(\\S)", "\n## $1")
    return budget.select_sections(_catalog(spark, sf_dir).select("doc_id", F.col("description").alias("prompt"), body.alias("body")), 150, 200)


_TIER = f"""{_CAT}, {_PROMPTS}, {_LEX}, ranked5 AS (SELECT prompt_id, conv_id, turn // 2 AS now, doc_id, score, rank FROM lextop JOIN prompts USING (prompt_id) WHERE rank <= 5),
    loads AS (SELECT prompt_id, conv_id, now, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY rank) AS place FROM ranked5 WHERE score >= 10) WHERE place <= 2),
    res AS (SELECT DISTINCT r.prompt_id, l.doc_id FROM (SELECT DISTINCT prompt_id, conv_id, now FROM ranked5) r JOIN loads l ON l.conv_id = r.conv_id AND l.now < r.now),
    offered AS (SELECT * FROM ranked5 WHERE (prompt_id, doc_id) NOT IN (SELECT (prompt_id, doc_id) FROM loads)),
    shown AS (SELECT r.prompt_id, o.doc_id, max(o.now) AS last FROM (SELECT DISTINCT prompt_id, conv_id, now FROM ranked5) r JOIN offered o ON o.conv_id = r.conv_id AND o.now < r.now GROUP BY ALL),
    bk AS (SELECT DISTINCT conv_id AS basket, doc_id AS item FROM loads), pr AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM bk x JOIN bk y ON x.basket = y.basket AND x.item <> y.item GROUP BY ALL HAVING count(*) >= 2),
    cn AS (SELECT item AS a, count(*) AS n FROM bk GROUP BY 1), cf AS (SELECT a, pr.b, support, round(support / n::DOUBLE, 9) AS confidence FROM pr JOIN cn USING (a)),
    ru AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, support DESC, b) AS rank FROM cf) WHERE rank <= 2),
    pc AS (SELECT prompt_id, ru.b AS doc_id, max(confidence) AS confidence, max(support) AS support FROM loads JOIN ru ON ru.a = loads.doc_id GROUP BY ALL),
    pd AS (SELECT prompt_id, doc_id, row_number() OVER (PARTITION BY prompt_id ORDER BY confidence DESC, support DESC, doc_id) AS rank FROM pc WHERE (prompt_id, doc_id) NOT IN (SELECT (prompt_id, doc_id) FROM loads)),
    alls AS (SELECT prompt_id, now, doc_id, 0 AS tier, rank FROM offered UNION ALL SELECT prompt_id, (SELECT any_value(now) FROM ranked5 r WHERE r.prompt_id = pd.prompt_id), doc_id, 1, rank FROM pd WHERE rank <= 2 AND (prompt_id, doc_id) NOT IN (SELECT (prompt_id, doc_id) FROM offered)),
    kept AS (SELECT prompt_id, doc_id, tier, rank, activation_tokens AS tokens FROM alls LEFT JOIN shown USING (prompt_id, doc_id) JOIN cat USING (doc_id) WHERE (prompt_id, doc_id) NOT IN (SELECT (prompt_id, doc_id) FROM res) AND (last IS NULL OR now - last >= 2)),
    pl AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER w AS running FROM kept WINDOW w AS (PARTITION BY prompt_id ORDER BY tier, rank, doc_id))"""


@query(f"WITH {_TIER} SELECT prompt_id, doc_id, place, running::BIGINT AS running FROM pl WHERE running <= 400")
def summary_tier(spark, sf_dir):
    """Each prompt of a conversation: what lower ranks and earlier conversations offer besides what loads or has loaded; the clock counts prompts."""
    cat = _catalog(spark, sf_dir)
    clock = _prompts(spark, sf_dir).select("prompt_id", "conv_id", F.floor(F.col("turn") / 2).cast("long").alias("now"))
    ranked = retrieval.lexical_top(_prompts(spark, sf_dir), cat, 5).join(clock, "prompt_id")
    place = F.row_number().over(W.partitionBy("prompt_id").orderBy("rank"))
    loads = ranked.where("score >= 10").withColumn("place", place).where("place <= 2").select("prompt_id", "conv_id", "now", "doc_id")
    asked = ranked.select("prompt_id", "conv_id", F.col("now").alias("at")).distinct()
    before = lambda df: asked.join(df.select("conv_id", "now", "doc_id"), "conv_id").where("now < at")
    residents = before(loads).select("prompt_id", "doc_id").distinct()
    shown = before(ranked.join(loads, ["prompt_id", "doc_id"], "left_anti")).groupBy("prompt_id", "doc_id").agg(F.max("now").alias("last"))
    rules = sessions.associations(loads.select(F.col("conv_id").alias("basket"), F.col("doc_id").alias("item")))
    predicted = sessions.predict_next(loads.select(F.col("prompt_id").alias("key"), F.col("doc_id").alias("item")), rules).select(F.col("key").alias("prompt_id"), F.col("item").alias("doc_id"), "rank")
    return budget.summary_tier(ranked, residents, shown, predicted, cat.select("doc_id", F.col("activation_tokens").alias("tokens")), load_floor=10, apart=2)


# Metrics ----------------------------------------------------------------------------------------------------------------

_PRED = "pred AS (SELECT * FROM (SELECT lang AS task_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('m' || chr(0) || doc_id::VARCHAR)) AS rank FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE rank <= 60)"
_RM = """gold AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY relevance DESC) AS place FROM qrels WHERE relevance > 0),
    ideal AS (SELECT task_id, count(*) AS gold, sum((pow(2, relevance) - 1) / log2(place + 1)) FILTER (WHERE place <= 50) AS ideal FROM gold GROUP BY task_id),
    hit AS (SELECT task_id, rank, relevance, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS seen FROM pred JOIN gold USING (task_id, doc_id)),
    found AS (SELECT task_id, min(rank) AS first, count(*) FILTER (WHERE rank <= 50) AS found, sum((pow(2, relevance) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 50) AS dcg, sum(seen / rank::DOUBLE) FILTER (WHERE rank <= 50) AS ps FROM hit GROUP BY task_id),
    m AS (SELECT task_id, coalesce((first = 1)::INT, 0) AS hit1, round(coalesce(found, 0) / gold::DOUBLE, 9) AS recall, round(coalesce(found, 0) / 50::DOUBLE, 9) AS precision, round(coalesce(1 / first::DOUBLE, 0), 9) AS mrr, round(coalesce(dcg / ideal, 0), 9) AS ndcg, round(coalesce(ps, 0) / least(gold, 50), 9) AS map, (coalesce(found, 0) = gold)::INT AS completeness FROM ideal LEFT JOIN found USING (task_id))"""


def _predictions(spark, sf_dir):
    """A list of sixty labelled documents for each language."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task_id")).join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs.withColumn("rank", F.row_number().over(W.partitionBy("task_id").orderBy(tx.stable_rank("m", F.col("doc_id"))))).where("rank <= 60")


@query(f"WITH {_PRED}, {_QRELS}, {_RM} SELECT * FROM m")
def ranked_metrics(spark, sf_dir):
    return metrics.ranked_metrics(_predictions(spark, sf_dir), _qrels(spark, sf_dir), 50)


@query(f"WITH {_PRED}, {_QRELS}, {_RM} SELECT count(*) AS cases, round(avg(hit1), 9) AS hit1, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg, round(avg(map), 9) AS map, round(avg(completeness), 9) AS completeness FROM m")
def macro_metrics(spark, sf_dir):
    return metrics.macro_mean(metrics.ranked_metrics(_predictions(spark, sf_dir), _qrels(spark, sf_dir), 50))


_CASES = f"""{_CAT}, {_PROMPTS}, {_LEX}, {_BLEND}, tox AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
    sel AS (SELECT prompt_id, list(doc_id ORDER BY rank) AS selected FROM lextop WHERE rank <= 2 AND score >= 10 GROUP BY 1), expd AS (SELECT prompt_id, list(doc_id ORDER BY rank) AS expected FROM blend WHERE rank <= 1 AND score >= 0.5 GROUP BY 1),
    forb AS (SELECT prompt_id, list(doc_id ORDER BY rank) AS forbidden FROM lextop WHERE rank <= 5 AND doc_id IN (SELECT * FROM tox) GROUP BY 1),
    cases AS (SELECT prompt_id, conv_id, turn, turn::VARCHAR AS tag, coalesce(selected, []) AS selected, coalesce(expected, []) AS expected, coalesce(forbidden, []) AS forbidden FROM prompts LEFT JOIN sel USING (prompt_id) LEFT JOIN expd USING (prompt_id) LEFT JOIN forb USING (prompt_id))"""
_CM = """c AS (SELECT *, len(list_intersect(selected, expected)) AS tp, list_position(list_transform(selected, lambda x: list_contains(expected, x)), true) AS place FROM cases),
    k AS (SELECT *, len(selected) - tp AS fp, len(expected) - tp AS fn FROM c)"""
_CMS = """count(*) AS cases, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum((fp = 0 AND fn = 0)::INT)::BIGINT AS exact, sum(len(list_intersect(selected, forbidden)))::BIGINT AS forbidden,
    round(coalesce(sum(tp)::DOUBLE / nullif(sum(tp + fp), 0), 1), 9) AS precision, round(coalesce(sum(tp)::DOUBLE / nullif(sum(tp + fn), 0), 1), 9) AS recall,
    round(avg(coalesce(place = 1, false)::INT) FILTER (WHERE len(expected) > 0), 9) AS hit1, round(avg((coalesce(place, 0) > 0)::INT) FILTER (WHERE len(expected) > 0), 9) AS hitk,
    round(avg(CASE WHEN place > 0 THEN 1 / place::DOUBLE ELSE 0 END) FILTER (WHERE len(expected) > 0), 9) AS mrr, round(avg((len(selected) = 0)::INT) FILTER (WHERE len(expected) = 0), 9) AS abstained"""


def _lists(ranked, name):
    return ranked.groupBy("prompt_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))


def _toxic(spark, sf_dir):
    return _read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()


def _with_lists(prompts, **lists):
    """Every prompt with its lists; without rows, an empty one."""
    for name, ranked in lists.items():
        prompts = prompts.join(_lists(ranked, name), "prompt_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<long>")))
    return prompts


def _cases(spark, sf_dir, found=None):
    """Prompts as cases: the lexical selection against the best after reranking; toxic candidates are forbidden."""
    found = _five(spark, sf_dir) if found is None else found
    best = _blended(spark, sf_dir, found).where("rank <= 1 and score >= 0.5")
    bad = found.join(_toxic(spark, sf_dir), "doc_id", "left_semi")
    return _with_lists(_prompts(spark, sf_dir).drop("prompt").withColumn("tag", F.col("turn").cast("string")), selected=found.where(_LOADED), expected=best, forbidden=bad)


@query(f"WITH {_CASES}, {_CM} SELECT {_CMS} FROM k")
def case_totals(spark, sf_dir):
    return metrics.case_metrics(_cases(spark, sf_dir))


@query(f"WITH {_CASES}, {_CM} SELECT tag, {_CMS} FROM k GROUP BY tag")
def case_totals_by_tag(spark, sf_dir):
    return metrics.case_metrics(_cases(spark, sf_dir), "tag")


@query(f"""WITH {_CASES}, runs AS (SELECT prompt_id, selected FROM cases UNION ALL SELECT prompt_id, coalesce(r, []) FROM prompts LEFT JOIN (SELECT prompt_id, list(doc_id ORDER BY rank) AS r FROM blend WHERE rank <= 2 GROUP BY 1) USING (prompt_id)),
    st AS (SELECT prompt_id, count(DISTINCT selected) = 1 AS same FROM runs GROUP BY 1) SELECT round(avg(same::INT), 9) AS stability FROM st""")
def selection_stability(spark, sf_dir):
    """Two runs of each case: the lexical selection and the reranked one."""
    found = _five(spark, sf_dir)
    one = _cases(spark, sf_dir, found).select(F.col("prompt_id").alias("case_id"), "selected")
    two = _with_lists(_prompts(spark, sf_dir), selected=_blended(spark, sf_dir, found)).select(F.col("prompt_id").alias("case_id"), "selected")
    return metrics.stability(one.union(two))


@query(f"""WITH {_CASES} SELECT count(*) AS cases, (SELECT sum(activation_tokens) FROM cat)::BIGINT AS tokens_before, 0 AS tokens_after, (SELECT sum(activation_tokens) FROM cat)::BIGINT AS tokens_avoided,
    (SELECT sum(full_tokens) FROM (SELECT unnest(selected) AS doc_id FROM cases) JOIN cat USING (doc_id))::BIGINT AS selected_tokens, round((SELECT sum(full_tokens) FROM (SELECT unnest(selected) AS doc_id FROM cases) JOIN cat USING (doc_id)) / count(*)::DOUBLE, 9) AS mean_selected_tokens FROM cases""")
def selection_accounting(spark, sf_dir):
    return metrics.selection_accounting(_cases(spark, sf_dir).select(F.col("prompt_id").alias("case_id"), F.col("selected").alias("doc_ids")), _catalog(spark, sf_dir))


@query(f"WITH {_CASES} SELECT prompt_id AS task_id FROM cases WHERE len(expected) > 0 AND turn <> 2")
def scorable_tasks(spark, sf_dir):
    """Prompts as tasks; those of the second turn count as generic."""
    gold = _cases(spark, sf_dir).select(F.col("prompt_id").alias("task_id"), F.when(F.col("turn") == 2, "generic_only").alias("task_type"), F.col("expected").alias("doc_ids"))
    return metrics.scorable_tasks(gold).select("task_id")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS longest FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return metrics.latency(_read(spark, sf_dir, "events"), "value", "event_type")


@query(f"""WITH {_CAT}, {_PRED}, l AS (SELECT sum(full_tokens)::BIGINT AS loaded_tokens FROM pred JOIN cat USING (doc_id) WHERE rank <= 2), t AS (SELECT sum(activation_tokens)::BIGINT AS catalog_tokens FROM cat), q AS (SELECT count(DISTINCT task_id) AS queries FROM pred)
    SELECT queries, catalog_tokens, loaded_tokens, catalog_tokens * queries AS baseline_tokens, catalog_tokens * queries - loaded_tokens AS avoided_tokens, round(1 - loaded_tokens / (catalog_tokens * queries)::DOUBLE, 9) AS reduction FROM t, l, q""")
def token_accounting(spark, sf_dir):
    return metrics.token_accounting(_predictions(spark, sf_dir), _catalog(spark, sf_dir))


_TURNS = f"""{_CASES}, loadn AS (SELECT prompt_id, conv_id, turn, doc_id, l.rank AS rank FROM lextop l JOIN prompts USING (prompt_id) WHERE l.rank <= 2 AND l.score >= 10),
    resd AS (SELECT prompt_id, list(doc_id) AS resident FROM (SELECT DISTINCT p.prompt_id, l.doc_id FROM prompts p JOIN loadn l ON l.conv_id = p.conv_id AND l.turn <= p.turn) GROUP BY 1),
    earl AS (SELECT DISTINCT p.prompt_id, l.doc_id FROM prompts p JOIN loadn l ON l.conv_id = p.conv_id AND l.turn < p.turn),
    inj AS (SELECT prompt_id, list(doc_id) AS injected FROM loadn WHERE (prompt_id, doc_id) NOT IN (SELECT (prompt_id, doc_id) FROM earl) GROUP BY 1),
    summ AS (SELECT prompt_id, list(doc_id) AS summarized FROM lextop WHERE rank BETWEEN 3 AND 5 GROUP BY 1), retr AS (SELECT prompt_id, list(doc_id) AS retrieved FROM lextop WHERE rank <= 5 GROUP BY 1),
    cost AS (SELECT prompt_id, sum(full_tokens)::DOUBLE AS tokens FROM loadn JOIN cat USING (doc_id) GROUP BY 1),
    turns AS (SELECT prompt_id, c.conv_id, c.turn, expected, forbidden, coalesce(resident, []) AS resident, coalesce(injected, []) AS injected, coalesce(summarized, []) AS summarized, coalesce(retrieved, []) AS retrieved, coalesce(tokens, 0) AS tokens
              FROM cases c LEFT JOIN resd USING (prompt_id) LEFT JOIN inj USING (prompt_id) LEFT JOIN summ USING (prompt_id) LEFT JOIN retr USING (prompt_id) LEFT JOIN cost USING (prompt_id))"""


def _turns(spark, sf_dir):
    """The turns of conversations: what the lexical selection loaded so far is resident."""
    prompts, cat = _prompts(spark, sf_dir).drop("prompt"), _catalog(spark, sf_dir)
    held = _five(spark, sf_dir)
    found = held.join(prompts, "prompt_id")
    loads = found.where(_LOADED).select("prompt_id", "conv_id", "turn", "doc_id", "rank")
    so_far = prompts.join(loads.select("conv_id", F.col("turn").alias("then"), "doc_id"), "conv_id").where("then <= turn").groupBy("prompt_id", "doc_id", "turn").agg(F.min("then").alias("rank"))
    fresh = loads.join(so_far.where("rank < turn").select("prompt_id", "doc_id"), ["prompt_id", "doc_id"], "left_anti")
    cost = loads.join(cat.select("doc_id", "full_tokens"), "doc_id").groupBy("prompt_id").agg(F.sum("full_tokens").cast("double").alias("tokens"))
    held = _with_lists(_cases(spark, sf_dir, held), resident=so_far, injected=fresh, summarized=found.where("rank >= 3"), retrieved=found)
    return held.join(cost, "prompt_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0.0)))


@query(f"""WITH {_TURNS}, x AS (SELECT *, len(list_intersect(expected, resident)) AS held, list_filter(expected, lambda e: NOT list_contains(resident, e)) AS missed FROM turns)
    SELECT round(avg(2 * held / (len(expected) + len(resident))::DOUBLE) FILTER (WHERE len(expected) > 0), 9) AS f1, round(avg(held / len(expected)::DOUBLE) FILTER (WHERE len(expected) > 0), 9) AS coverage,
    round(avg((held - len(list_intersect(list_intersect(expected, resident), injected))) / held::DOUBLE) FILTER (WHERE held > 0), 9) AS reuse, round(avg(len(list_intersect(missed, summarized)) / len(missed)::DOUBLE) FILTER (WHERE len(missed) > 0), 9) AS recovery,
    round(avg((len(injected) = 0)::INT) FILTER (WHERE len(expected) = 0), 9) AS abstained, round(avg(tokens), 9) AS tokens, sum(len(list_intersect(resident, forbidden)))::BIGINT AS forbidden FROM x""")
def turn_metrics(spark, sf_dir):
    return metrics.turn_metrics(_turns(spark, sf_dir))


@query(f"""WITH {_TURNS}, o AS (SELECT *, len(list_intersect(expected, retrieved)) / len(expected)::DOUBLE AS got, len(list_intersect(expected, resident)) / len(expected)::DOUBLE AS stay FROM turns WHERE len(expected) > 0)
    SELECT round(avg(got), 9) AS gold_retrieved, round(avg(stay), 9) AS gold_resident, round(avg(stay) FILTER (WHERE got > 0), 9) AS memory_retention FROM o""")
def retention_given_retrieval(spark, sf_dir):
    return metrics.retention_given_retrieval(_turns(spark, sf_dir))


@query(f"WITH {_TURNS}, ends AS (SELECT * FROM turns WHERE (conv_id, turn) IN (SELECT (conv_id, max(turn)) FROM prompts GROUP BY conv_id)) SELECT round(avg(len(list_intersect(expected, resident)) / len(expected)::DOUBLE) FILTER (WHERE len(expected) > 0), 9) AS retention, count(*) FILTER (WHERE len(expected) > 0) AS compactions FROM ends")
def compaction_retention(spark, sf_dir):
    """Conversations are compacted after their last prompt."""
    ends = _prompts(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return metrics.retention(_turns(spark, sf_dir).join(ends, ["conv_id", "turn"], "left_semi").select("expected", F.col("resident").alias("restored")))


@query("""WITH d AS (SELECT user_id AS run_id, count(*) AS completed, max(ts) AS last FROM events WHERE event_type <> 'signup' GROUP BY 1), t AS (SELECT user_id AS run_id, count(*) AS total FROM events GROUP BY 1), now AS (SELECT max(ts) AS now FROM events)
    SELECT run_id, coalesce(completed, 0) AS completed, total, CASE WHEN coalesce(completed, 0) >= total THEN 'complete' WHEN floor(epoch(now)) - floor(epoch(last)) <= 86400 THEN 'active' ELSE 'paused' END AS status FROM t LEFT JOIN d USING (run_id), now""")
def run_progress(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.lit(1).alias("n"), "event_type")
    now = e.agg(F.max("at")).first()[0]
    return metrics.progress(e.where("event_type <> 'signup'"), e.groupBy("run_id").agg(F.count("*").alias("total")), F.lit(now), 86_400)


@query(f"WITH {_CASES}, {_CM.replace("c AS (", "cc AS (").replace("FROM c)", "FROM cc)")}, {_PRED}, {_QRELS}, {_RM} SELECT 'routing' AS family, cases, precision, NULL AS ndcg FROM (SELECT {_CMS} FROM k) UNION ALL SELECT 'ranking', count(*), round(avg(precision), 9), round(avg(ndcg), 9) FROM m")
def report_union(spark, sf_dir):
    routing = case_totals(spark, sf_dir).select(F.lit("routing").alias("family"), "cases", "precision")
    return metrics.side_by_side(routing, macro_metrics(spark, sf_dir).select(F.lit("ranking").alias("family"), "cases", "precision", "ndcg"))


# Sessions ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_LOG}, {_FEAT} SELECT * FROM feat")
def access_features(spark, sf_dir):
    return sessions.access_features(_log(spark, sf_dir))


def _restore(policy: str, order: str):
    sql = f"WITH {_LOG}, {_FEAT}, w AS (SELECT *, last_use > max(last_use) OVER (PARTITION BY session) - 10 AS in_working_set FROM feat) SELECT session, item, in_working_set, row_number() OVER (PARTITION BY session ORDER BY in_working_set DESC, {order} insert_seq) AS place FROM w"

    def run(spark, sf_dir):
        return sessions.restore_order(sessions.access_features(_log(spark, sf_dir)), policy).select("session", "item", "in_working_set", "place")

    run.__name__ = f"restore_order_{policy}"
    query(sql)(run)


_restore("lru", "last_use DESC,")
_restore("lfu", "hits DESC, last_use DESC,")
_restore("index", "")


@query(f"WITH {_LOG} SELECT session, event_id, item, row_number() OVER (PARTITION BY session, item ORDER BY now) = 1 AS injected FROM log")
def first_injections(spark, sf_dir):
    return sessions.first_injections(_log(spark, sf_dir)).select("session", "event_id", "item", "injected")


@query(f"WITH {_LOG} SELECT session, event_id, last_value(event_id) OVER (PARTITION BY session, item ORDER BY now ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reused FROM log")
def repeated_prompts(spark, sf_dir):
    held = _log(spark, sf_dir).select("session", "event_id", "now", F.col("item").alias("prompt_key"), F.col("event_id").alias("selection"))
    return sessions.repeated_prompts(held).select("session", "event_id", "reused")


@query(f"""WITH RECURSIVE {_LOG}, a AS MATERIALIZED (SELECT DISTINCT session, item, now FROM log),
    s AS (SELECT session, item, min(now) AS now FROM a GROUP BY ALL UNION ALL SELECT session, item, now FROM (SELECT a.session, a.item, min(a.now) AS now FROM s JOIN a ON a.session = s.session AND a.item = s.item AND a.now >= s.now + 10 GROUP BY a.session, a.item, s.now))
    SELECT session, item, now FROM s""")
def summary_spacing(spark, sf_dir):
    return sessions.summary_spacing(_log(spark, sf_dir).select("session", "item", "now"))


@query("SELECT * FROM (SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)")
def trace_tail(spark, sf_dir):
    return sessions.trace_tail(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"))


@query("SELECT * FROM (SELECT event_id, user_id, ts FROM events WHERE ts IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 200) ORDER BY ts, event_id")
def daily_tail(spark, sf_dir):
    """The last 200 events of a trace that lies in one folder a day: whole days are left unread."""
    path = folder(spark, "trace")
    _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day")).write.partitionBy("day").parquet(path)
    return tables.tail(spark, path, 200)


@query(f"WITH {_BASKETS}, p AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM p")
def pair_support(spark, sf_dir):
    return sessions.pair_counts(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item")))


_RULES = f"""{_BASKETS}, p AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY ALL HAVING count(*) >= 2),
    n AS (SELECT item AS a, count(*) AS n FROM b GROUP BY 1), c AS (SELECT a, p.b, support, round(support / n::DOUBLE, 9) AS confidence FROM p JOIN n USING (a)),
    rules AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, support DESC, b) AS rank FROM c) WHERE rank <= 2)"""


@query(f"WITH {_RULES} SELECT * FROM rules")
def association_rules(spark, sf_dir):
    return sessions.associations(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item")))


@query(f"""WITH {_RULES}, sel AS (SELECT basket AS key, item FROM b), x AS (SELECT key, rules.b AS item, max(confidence) AS confidence, max(support) AS support FROM sel JOIN rules ON rules.a = sel.item GROUP BY ALL),
    y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.key = x.key AND sel.item = x.item))
    SELECT key, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, support DESC, item) AS rank FROM y) WHERE rank <= 2""")
def next_items(spark, sf_dir):
    baskets = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item")).distinct()
    return sessions.predict_next(baskets.select(F.col("basket").alias("key"), "item"), sessions.associations(baskets)).select("key", "item", "rank")


def session_events(spark, sf_dir) -> DataFrame:
    """Events as prompts that select one item and offer the next; a signup also compacts to a budget of eight, every fiftieth event ends its session."""
    log = _log(spark, sf_dir)
    asked = log.select("session", F.lit("prompt").alias("event"), "ts", (F.col("event_id") * 2).alias("event_id"), F.array("item").alias("selected"), F.lit(None).cast("int").alias("budget"), F.array(F.col("item") + 1).alias("offered"))
    packed = log.where("event_type = 'signup'").select("session", F.lit("compact").alias("event"), "ts", (F.col("event_id") * 2 + 1).alias("event_id"), F.lit(None).cast("array<long>").alias("selected"), F.lit(8).alias("budget"), F.lit(None).cast("array<long>").alias("offered"))
    ended = log.where("event_id % 50 = 49").select("session", F.lit("end").alias("event"), "ts", (F.col("event_id") * 2 + 1).alias("event_id"), F.lit(None).cast("array<long>").alias("selected"), F.lit(None).cast("int").alias("budget"), F.lit(None).cast("array<long>").alias("offered"))
    return asked.unionByName(packed.where("(event_id - 1) / 2 % 50 <> 49")).unionByName(ended)


@query(f"""WITH RECURSIVE {_LOG}, {_FEAT}, w AS (SELECT *, last_use > max(last_use) OVER (PARTITION BY session) - 10 AS near FROM feat),
    c AS MATERIALIZED (SELECT session AS prompt_id, item AS doc_id, 300 + ('0x' || substr(sha256(item::VARCHAR), 1, 8))::BIGINT % 2201 AS tokens, row_number() OVER (PARTITION BY session ORDER BY near DESC, last_use DESC, insert_seq) AS rank FROM w),
    f AS (SELECT prompt_id, 0::BIGINT AS rank, NULL::BIGINT AS doc_id, 0::BIGINT AS tokens, NULL::VARCHAR AS reason, 0::BIGINT AS used FROM (SELECT DISTINCT prompt_id FROM c)
          UNION ALL SELECT c.prompt_id, c.rank, c.doc_id, c.tokens, CASE WHEN f.used + c.tokens > 8000 THEN 'token-budget' END, CASE WHEN f.used + c.tokens > 8000 THEN f.used ELSE f.used + c.tokens END FROM f JOIN c ON c.prompt_id = f.prompt_id AND c.rank = f.rank + 1 WHERE f.used < 8000)
    SELECT prompt_id AS session, doc_id AS item, rank AS place, reason IS NULL AS restored FROM f WHERE rank > 0""")
def compaction_snapshot(spark, sf_dir):
    """What a compaction after each session's last event would restore: the working set first, admitted under a budget."""
    held = sessions.restore_order(sessions.access_features(_log(spark, sf_dir)), "lru")
    item = held.select(F.col("session").alias("prompt_id"), F.col("place").alias("rank"), F.col("item").alias("doc_id"), tx.synthetic_cost(F.col("item")).alias("tokens"), F.col("item").cast("string").alias("content_hash"))
    return budget.greedy_budget(item, 8000).select(F.col("prompt_id").alias("session"), F.col("doc_id").alias("item"), F.col("rank").cast("long").alias("place"), F.col("reason").isNull().alias("restored"))


@query()
def session_trace(spark, sf_dir):
    return live.trace_batch(session_events(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LOG}, said AS (SELECT session, 'prompt' AS event, item, ts, event_id * 2 AS id FROM log UNION ALL SELECT session, 'compact', NULL, ts, event_id * 2 + 1 FROM log WHERE event_type = 'signup' AND event_id % 50 <> 49 UNION ALL SELECT session, 'end', NULL, ts, event_id * 2 + 1 FROM log WHERE event_id % 50 = 49),
    ev AS MATERIALIZED (SELECT session, event, item, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS pos FROM said),
    f AS (SELECT session, 0::BIGINT AS pos, 0::BIGINT AS clock, 0::BIGINT AS seq, []::STRUCT(item BIGINT, last BIGINT, seq BIGINT, since BIGINT)[] AS held FROM (SELECT DISTINCT session FROM ev)
          UNION ALL SELECT e.session, e.pos, CASE e.event WHEN 'prompt' THEN clock + 1 WHEN 'end' THEN 0 ELSE clock END, CASE e.event WHEN 'prompt' THEN seq + 1 WHEN 'end' THEN 0 ELSE seq END,
              CASE WHEN e.event = 'end' THEN [] WHEN e.event = 'compact' THEN list_transform(list_sort(list_transform(held, lambda h: {{'far': (h.last <= clock - 10)::INT, 'newest': -h.last, 'seq': h.seq, 'h': h}}))[1:8], lambda x: {{'item': x.h.item, 'last': clock, 'seq': x.h.seq, 'since': x.h.since}})
                   WHEN list_contains(list_transform(held, lambda h: h.item), e.item) THEN list_transform(held, lambda h: {{'item': h.item, 'last': CASE WHEN h.item = e.item THEN clock + 1 ELSE h.last END, 'seq': h.seq, 'since': h.since}})
                   ELSE list_append(held, {{'item': e.item, 'last': clock + 1, 'seq': seq, 'since': clock + 1}}) END
          FROM f JOIN ev e ON e.session = f.session AND e.pos = f.pos + 1)
    SELECT session, h.item AS item, h.since AS since FROM (SELECT session, unnest(held) AS h FROM (SELECT session, arg_max(held, pos) AS held FROM f GROUP BY session))""")
def session_residents(spark, sf_dir):
    return live.residents(live.trace_batch(session_events(spark, sf_dir), "lru"))


@query(f"""WITH {_LOG} SELECT session, event_id, row_number() OVER (PARTITION BY session, item % 30 ORDER BY now) > 1 AS recalled, first_value(item) OVER (PARTITION BY session, item % 30 ORDER BY now) AS taken FROM log""")
def session_recall(spark, sf_dir):
    """Prompts of thirty different keys, fewer than the memo holds: a repeat takes the selection that its key had first."""
    log = _log(spark, sf_dir)
    events = log.select("session", F.lit("prompt").alias("event"), "ts", "event_id", F.array("item").alias("selected"), F.lit(None).cast("int").alias("budget"), (F.col("item") % 30).cast("string").alias("prompt_key"))
    return live.trace_batch(events).select("session", "event_id", "recalled", F.concat("injected", "deduplicated")[0].alias("taken"))


# Sampling ---------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT o_orderpriority AS s, count(*) AS n, least(500, sum(count(*)) OVER ()) * count(*) / (sum(count(*)) OVER ())::DOUBLE AS share, least(500, sum(count(*)) OVER ()) AS size FROM orders GROUP BY 1),
    f AS (SELECT *, floor(share) AS seats, row_number() OVER (ORDER BY share - floor(share) DESC, s DESC) AS place FROM c), g AS (SELECT s, seats + (place <= size - sum(seats) OVER ())::INT AS seats FROM f),
    o AS (SELECT o_orderkey, o_orderpriority AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('seed' || chr(0) || o_orderkey::VARCHAR)) AS place FROM orders)
    SELECT o_orderkey, s AS o_orderpriority FROM o JOIN g USING (s) WHERE place <= seats""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 500, "seed").select("o_orderkey", "o_orderpriority")


@query(f"WITH {_QRELS} SELECT DISTINCT doc_id FROM qrels WHERE relevance > 0 AND task_id IN ('en', 'de')")
def required_ids(spark, sf_dir):
    return sampling.required_ids(_qrels(spark, sf_dir), spark.createDataFrame([("en",), ("de",)], "task_id string"))


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY {_rank('fill', 'doc_id')}, doc_id LIMIT 100")
def hash_fill(spark, sf_dir):
    return sampling.hash_fill(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").select("doc_id"), 100, "fill")


@query(f"""WITH ch AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), o AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ch) ORDER BY ('0x' || substr({_rank('pool', 'doc_id')}, 1, 12))::BIGINT, doc_id LIMIT (SELECT greatest(0, 150 - count(*)) FROM ch))
    SELECT doc_id, true AS chosen FROM ch UNION ALL SELECT doc_id, false FROM o""")
def fill_pool(spark, sf_dir):
    return sampling.fill_pool(_toxic(spark, sf_dir), _read(spark, sf_dir, "documents").select("doc_id"), 150, "pool")


@query(f"""WITH {_CAT}, a AS (SELECT item_id, unnest({_wrd("text")}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1),
    m AS (SELECT doc_id, unnest({_wrd("name || ' ' || description")}) AS w FROM cat WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
    s AS (SELECT doc_id, item_id, count(*) AS k FROM m JOIN a USING (w) GROUP BY ALL)
    SELECT doc_id, round(max(k / n::DOUBLE), 9) AS overlap FROM s JOIN n USING (item_id) GROUP BY doc_id ORDER BY 2 DESC, {_rank("hard", "doc_id")}, doc_id DESC LIMIT 50""")
def hard_negatives(spark, sf_dir):
    tasks = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), "text")
    return sampling.hard_negatives(_catalog(spark, sf_dir), tasks, _read(spark, sf_dir, "labels").select("doc_id"), 50, "hard")


@query(f"WITH {_LOG}, g AS (SELECT event_id % 9000 AS query_id, item AS doc_id FROM log), one AS (SELECT query_id, min(doc_id) AS doc_id FROM g GROUP BY 1 HAVING count(*) = 1) SELECT doc_id, count(*) AS queries FROM one GROUP BY 1 HAVING count(*) >= 2")
def single_gold_groups(spark, sf_dir):
    return sampling.single_gold_groups(_log(spark, sf_dir).select((F.col("event_id") % 9000).alias("query_id"), F.col("item").alias("doc_id"), F.lit(1.0).alias("relevance")))


_BLOCKS = f"""h AS (SELECT doc_id, row_number() OVER (ORDER BY {_rank("deal", "doc_id")}, doc_id) - 1 AS p FROM documents),
    blocks AS (SELECT doc_id, 'focused' AS archetype, p AS session, 0 AS slot FROM h WHERE p < 10 UNION ALL SELECT doc_id, 'drift', (p - 10) // 4, (p - 10) % 4 FROM h WHERE p BETWEEN 10 AND 49 UNION ALL SELECT doc_id, 'return', (p - 50) // 4, (p - 50) % 4 FROM h WHERE p BETWEEN 50 AND 89)"""


@query(f"WITH {_BLOCKS} SELECT * FROM blocks")
def session_blocks(spark, sf_dir):
    return sampling.deal_blocks(_read(spark, sf_dir, "documents"), 10, "deal")


_NEXT = _BLOCKS.replace("doc_id) - 1 AS p", "doc_id) - 91 AS p").replace("p < 10", "p BETWEEN 0 AND 9")


@query(f"WITH {_NEXT} SELECT * FROM blocks")
def heldout_blocks(spark, sf_dir):
    """The next block of the same order: no document of ``session_blocks`` is in it."""
    return sampling.deal_blocks(_read(spark, sf_dir, "documents"), 10, "deal", block=1)


@query(f"""WITH {_BLOCKS}, q AS (SELECT event_id AS query_id, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_rank("turn", "query_id")}) AS visit FROM q)
    SELECT archetype, session, row_number() OVER (PARTITION BY archetype, session ORDER BY visit, slot) AS turn, doc_id, query_id FROM blocks JOIN v USING (doc_id) WHERE visit <= 2""")
def session_turns(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    asked = _read(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), (F.col("event_id") % F.lit(docs.count())).alias("doc_id"))
    return sampling.session_turns(sampling.deal_blocks(docs, 10, "deal"), asked, "turn")


@query(f"WITH {_CAT} SELECT name || ': ' || description AS prompt, doc_id::VARCHAR AS expected FROM cat UNION ALL SELECT unnest(['what is the weather', 'tell me a joke', 'good morning']), NULL")
def routing_cases(spark, sf_dir):
    return sampling.routing_cases(_catalog(spark, sf_dir), ["what is the weather", "tell me a joke", "good morning"])


@query(f"WITH {_QRELS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM qrels WHERE relevance = 0)")
def held_out_documents(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id").join(_qrels(spark, sf_dir).where("relevance = 0").select("doc_id"), "doc_id", "left_anti")


# Chunks and vectors -----------------------------------------------------------------------------------------------------


_back = lambda n, c: f"nullif(instr(reverse(substr(t, {n} + 1, 4001)), {c}), 0)"
_gap = lambda n: f"""{n} + 4001 - least({_back(n, "' '")}, {_back(n, "chr(10)")})"""
_stop = lambda n: f"CASE WHEN {n} + 4000 < length(t) AND {_gap(n)} > {n} + 2400 THEN {_gap(n)} ELSE least(length(t), {n} + 4000) END"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH RECURSIVE {_CAT}, b AS (SELECT doc_id, trim(replace(coalesce(body, ''), chr(13) || chr(10), chr(10)), {_WHITE}) AS t FROM cat),
    w AS (SELECT doc_id, t, 0::BIGINT AS head, ({_stop("0")})::BIGINT AS stop FROM b UNION ALL SELECT doc_id, t, n, ({_stop("n")})::BIGINT FROM (SELECT doc_id, t, greatest(head + 1, stop - 400) AS n FROM w WHERE stop < length(t))),
    x AS (SELECT doc_id, head, trim(substr(t, head + 1, stop - head), {_WHITE}) AS piece FROM w WHERE length(t) <= 4000 OR trim(substr(t, head + 1, stop - head), {_WHITE}) <> '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY head) - 1 AS position, sha256(name || ' | ' || description || ' | ' || piece) AS content_hash FROM x JOIN cat USING (doc_id)""")
def document_chunks(spark, sf_dir):
    return vectors.chunks(_catalog(spark, sf_dir)).drop("text")


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN embedding[1:63] WHEN vec_id % 11 = 0 THEN list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 'nan'::FLOAT ELSE v END) ELSE embedding END AS embedding FROM embeddings)
    SELECT vec_id, len(embedding) AS size FROM e WHERE len(embedding) <> 64 OR len(list_filter(embedding, lambda v: NOT isfinite(v))) > 0""")
def invalid_vectors(spark, sf_dir):
    """Every seventh vector is cut short, every eleventh has values that are no numbers."""
    e = F.col("embedding")
    spoilt = F.when(F.col("vec_id") % 7 == 0, F.slice(e, 1, 63)).when(F.col("vec_id") % 11 == 0, F.transform(e, lambda v: F.when(v > 0, F.lit(float("nan")).cast("float")).otherwise(v))).otherwise(e)
    return vectors.invalid_vectors(_read(spark, sf_dir, "embeddings").withColumn("embedding", spoilt), 64).select("vec_id", F.size("embedding").alias("size"))


@query("""WITH k AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT key FROM k WHERE doc_id % 3 = 0 UNION SELECT sha256(text) FROM benchmark)
    SELECT 'embed' AS work, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT 'keep', count(*) FROM c WHERE key IN (SELECT key FROM k) UNION ALL SELECT 'prune', count(*) FROM c WHERE key NOT IN (SELECT key FROM k)""")
def incremental_embedding(spark, sf_dir):
    """What has to be embedded anew, what stays and what goes, against a cache of every third document and other texts."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("key"))
    cache = docs.where("doc_id % 3 = 0").select("key").union(_read(spark, sf_dir, "benchmark").select(tx.content_hash(F.col("text")))).distinct()
    count = lambda df, work: df.agg(F.lit(work).alias("work"), F.count("*").alias("n")).select("work", "n")
    return count(vectors.to_embed(docs, cache), "embed").union(count(vectors.still_valid(docs, cache), "keep")).union(count(vectors.to_embed(cache, docs), "prune"))


@query()
def encoded_items(spark, sf_dir):
    return vectors.encode(_read(spark, sf_dir, "benchmark").select("item_id", "text"), vectors.hashing_encoder()).drop("text")
