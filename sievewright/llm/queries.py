"""The registered queries of the ten operators, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, decontaminate, hard_negatives, language_spans, mixing, near_dedup, ordinal_quality, pii_bootstrap, rule_learning, secret_grammar, site_lines, url_filter, warc_archive
from .scratch import table

#: Hosts that are blocked with all their subdomains.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null and empty texts have zero counts and fail the base rule; long texts are counted whole; repeated rows and ties are judged alike; without labels the base rule decides alone; an empty table gives no row; other columns are not read."""
    return rule_learning.judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page. Null and empty urls have an empty host and path and are allowed; long urls are probed with all their prefixes; repeated rows are judged alike, of rules the longest wins; an empty table gives no row; other columns are not read."""
    entries = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "entry string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), entries).select("page_id", "host", "path", "rule", "verdict")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null counts as empty, which has no span; long texts are scanned whole; repeated rows get equal spans; without labelled credentials only base spans are found; an empty table gives no row; other columns are not read."""
    return secret_grammar.scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as often as drawn, with ``copy``. A null source is one source, null and empty and long texts are kept as they are; rows of one doc_id draw alike, rows without one by their content; an empty table gives no row; other columns are kept."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document with its class. Null, empty and wordless texts are alone unless an equal one exists; long texts are compared whole; repeated rows share a class, named by the least doc_id; a null doc_id has a null class; an empty table gives no row; other columns are not read."""
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; toxic ones are grade 0, others 1 and their quality. Null and empty texts score as without words; long texts are scored whole; repeated rows are graded alike; without ratings grades are null and all are kept; an empty table gives no row; other columns are not read."""
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))
    return ordinal_quality.grade(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null counts as empty, which has no span; long texts are read whole; repeated rows get equal spans; without seeds nothing is discovered; an empty table gives no row; other columns are not read."""
    return pii_bootstrap.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document and test item that it holds. Null and empty texts and items match nothing; long ones are aligned whole; repeated rows are judged one by one, of equal passages the first is told; empty tables give no row; other columns are not read."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; only rows that are not held out teach. Null and empty texts and those without a letter are ``und`` with score 0; long texts are scored whole; repeated rows are labelled alike, ties go to the first language; a null doc_id is not held out; an empty table gives no row; other columns are not read."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(language_spans.held_out(F.col("doc_id")), F.lit(False))
    labelled = language_spans.label_languages(docs.select("doc_id", "text"), docs.where(~held_out))
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document without its boilerplate. Null text stays null and empty text empty; long texts are cut whole; copies of a page count once; a null source is one host; an empty table gives no row; other columns are not read."""
    return site_lines.drop_boilerplate(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector of 64 finite components; null vectors, other lengths and null, NaN or infinite components have none. Repeated rows are vectors of their own, ties go to the smaller centroid, a null vec_id starts no centroid; an empty table gives no row; other columns are not read."""
    return centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for each anchor and positive. Rows with a null vec_id, label or vector or a component that is null or not finite take no part, other vector lengths do not meet; repeated rows count once, ties go to the smaller vec_id; an empty table gives no row; other columns are not read."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(v.withColumn("label", label))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page, written and read back. Null html is an empty payload and a null url a name of its own; long pages are one record; repeated rows of the smallest page_id are all responses, a null page_id is never the smallest; an empty table gives no row; other columns are not read."""
    return warc_archive.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_secret_scan, op4_mixing, op5_near_dedup, op6_quality_classifier, op7_personal_data, op8_decontamination, op9_language_id, op10_line_dedup, op11_centroid_clustering, op12_hard_negatives, op13_warc_archive)}


_WHITE = "concat(' ', chr(9), chr(11), chr(12), chr(13))"


def _cluster_sql() -> str:
    nearest = lambda k: f"a{k} AS MATERIALIZED (SELECT i, min((n + m - 2 * list_dot_product(k.v, s{k}.v)::BIGINT) * 16 + c) AS best FROM k, (SELECT c, v, list_dot_product(v, v)::BIGINT AS m FROM s{k}) s{k} GROUP BY i)"
    moved = lambda k: f"""p{k} AS (SELECT best % 16 AS c, j, sum(v[j + 1]::BIGINT)::BIGINT AS t, count(*) AS n FROM a{k} JOIN k USING (i), range(0, 64) r(j) GROUP BY ALL),
        m{k} AS (SELECT c, list(((t - ((t % n) + n) % n) // n)::DOUBLE ORDER BY j) AS v FROM p{k} GROUP BY c), s{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.v, s{k}.v) AS v FROM s{k} LEFT JOIN m{k} USING (c))"""  # noqa: E731
    rounds = ", ".join(f"{nearest(k)}, {moved(k)}" for k in range(3))
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, v, list_dot_product(v, v)::BIGINT AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
        s0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
        {rounds}, {nearest(3)},
        e AS (SELECT vec_id, (best % 16)::INTEGER AS cluster, best // 16 AS distance FROM a3 JOIN k USING (i))
        SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
            (SELECT sha256(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ',')) FROM s3 WHERE c = cluster) AS centroid_sha256 FROM e"""


_NEGATIVES = """
    WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND len(a.v) = len(b.v)),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""

_BASE32 = "array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (j // 4) + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31), 1)), '')"
_WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), d AS (SELECT *, sha1(payload) AS h, page_id = first OR first IS NULL AS own FROM p)
    SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT own THEN first END AS refers_to FROM d"""


def oracle_sql() -> dict[str, str]:
    listed = " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in BLOCKED_HOSTS)
    fits = lambda host, path: f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}'))"
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    says = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + f" WHEN {listed} THEN 'block' ELSE 'allow' END"
    return {
        "op11_centroid_clustering": _cluster_sql(),
        "op12_hard_negatives": _NEGATIVES,
        "op13_warc_archive": _WARC,
        "op2_url_filter": f"""
            WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM r)
            SELECT page_id, host, path, {rule} AS rule, {says} AS verdict FROM s""",
        "op4_mixing": f"""
            WITH sizes AS (SELECT coalesce(source, chr(0)) AS s, count(*) AS n FROM documents GROUP BY 1),
            rates AS (SELECT s, (SELECT sum(n) FROM sizes)::DOUBLE * pow(n, {mixing.TEMPERATURE}) / (SELECT sum(pow(n, {mixing.TEMPERATURE})) FROM sizes) / n AS rate FROM sizes),
            steps AS (SELECT s, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 40))::BIGINT + 1)) AS k FROM rates),
            cdf AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM steps),
            u AS (SELECT doc_id, text, lang, source, n_chars, ('0x' || substr(sha256('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
            counts AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.s = coalesce(u.source, chr(0)) AND cdf.c <= u.u) AS n FROM u)
            SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy FROM counts""",
        "op10_line_dedup": f"""
            WITH pages AS (SELECT DISTINCT coalesce(source, chr(0)) AS h, text FROM documents WHERE text IS NOT NULL),
            totals AS (SELECT h, count(*) AS pages FROM pages GROUP BY h),
            lines AS (SELECT DISTINCT h, text, trim(line, {_WHITE}) AS line FROM (SELECT h, text, unnest(string_split(text, chr(10))) AS line FROM pages)),
            often AS (SELECT h, line FROM (SELECT h, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY h, line) JOIN totals USING (h) WHERE n >= {site_lines.MIN_PAGES} AND n > {site_lines.MAX_SHARE} * pages),
            known AS (SELECT h, list(line) AS bad FROM often GROUP BY h),
            cut AS (SELECT doc_id, source, text, bad, CASE WHEN bad IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, trim(x, {_WHITE}))), chr(10)) END AS rest
                    FROM documents LEFT JOIN known ON h = coalesce(source, chr(0))),
            done AS (SELECT *, CASE WHEN rest IS NULL THEN 0 ELSE len(string_split(text, chr(10))) - len(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, trim(x, {_WHITE})))) END AS n_dropped FROM cut),
            told AS (SELECT *, n_dropped > 0 AND NOT regexp_matches(rest, '[^ \\t\\n\\v\\f\\r]') AS all_boilerplate FROM done)
            SELECT doc_id, source, CASE WHEN all_boilerplate THEN '' WHEN n_dropped > 0 THEN rest ELSE text END AS text, n_dropped, all_boilerplate FROM told""",
    }
