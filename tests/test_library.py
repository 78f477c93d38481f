"""Small golden cases of the library's own operators, and stream against batch."""

import hashlib
import json
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators import budget, catalog, context, index, metrics, retrieval, sampling, sessions, vectors
from sievewright.plans import queries as plans
from sievewright.sources import tables
from sievewright.streaming import sessions as live


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first()[0]


def test_token_estimate(spark):
    assert [one(spark, t, tx.estimate_tokens) for t in ("hello world", "", None)] == [3, 0, 0]


def test_front_matter_and_outline(spark):
    doc = "---\nname: 'pdf'\ndescription: >\n  reads\n  files\n---\n# One\ntext\n## Two ##\n#### four\n"
    assert one(spark, doc, lambda c: tx.front_matter(c, "name")) == "pdf"
    assert one(spark, doc, lambda c: tx.front_matter(c, "description")) == "reads files"
    assert one(spark, doc, tx.outline) == ["One", "Two"]


def test_redaction_keeps_headings(spark):
    assert one(spark, "# A\none two", tx.redact_body).split("\n") == ["# A", "lorem lorem lorem lorem"]


def test_repeated_lines(spark):
    line = "this line is long enough to be counted as a line"
    cat = spark.createDataFrame([(1, line + "\nx"), (2, "y\n" + line)], "doc_id long, body string")
    r = catalog.repeated_line_tokens(cat).first()
    assert (r.repeated_lines, r.duplicate_tokens) == (1, 15)


def test_catalog_dedup(spark):
    rows = [("all", "a", "x/a/long"), ("all", "a", "x/a"), ("all", "a", ".cursor/a"), ("en", "a", "y")]
    df = spark.createDataFrame(rows, "provider string, name string, path string")
    assert {r.path for r in catalog.logical_dedup(df).collect()} == {"x/a", "y"}
    assert {r.path for r in catalog.name_dedup(df).where("reason is null").collect()} == {"x/a", "x/a/long", "y"}


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("s"))
    prints = {catalog.fingerprint(d).first()[0] for d in (df, df.orderBy(F.desc("id")).repartition(3))}
    assert len(prints) == 1 and prints != {catalog.fingerprint(df.limit(49)).first()[0]}


def test_vector_top_and_abstention(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "prompt_id long, embedding array<float>")
    pool = spark.createDataFrame([(1, [0.96, 0.04]), (2, [0.0, 1.0]), (3, [1.0])], "doc_id long, embedding array<float>")
    assert [r.doc_id for r in retrieval.vector_top(q, pool, 1, 0.42).collect()] == [1]
    assert retrieval.vector_top(q, pool.where("doc_id = 2"), 1, 0.42).isEmpty()


def test_vectors_on_a_grid(spark, monkeypatch):
    """The same list at any size of block and shard as by one broadcast; sizes, null and zero vectors and ties included."""
    rng = np.random.default_rng(2)
    vector = lambda i: None if i % 50 == 7 else [0.0] * 4 if i % 50 == 9 else [float(x) for x in rng.integers(-2, 3, size=3 + i % 2)]
    q = spark.createDataFrame([(i, vector(i)) for i in range(300)], "prompt_id long, embedding array<float>")
    pool = spark.createDataFrame([(i, vector(i)) for i in range(500)], "doc_id long, embedding array<float>")
    one = sorted(map(tuple, retrieval.vector_top(q, pool, 4, 0.1).collect()))
    assert len(one) > 900
    for block, shard in ((100, 1000), (37, 60), (299, 7)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "POOL_SHARD", shard)
        assert sorted(map(tuple, retrieval.vector_top(q, pool, 4, 0.1).collect())) == one
    assert retrieval.vector_top(q, pool.limit(0), 4).collect() == []


def test_exact_name(spark):
    p = spark.createDataFrame([(1, "run pdf-extraction on this document")], "prompt_id long, prompt string")
    cat = spark.createDataFrame([(1, "pdf_extraction"), (2, "sheets")], "doc_id long, name string")
    assert [tuple(r) for r in retrieval.exact_name_matches(p, cat).collect()] == [(1, 1)]
    many = cat.union(spark.range(10, 409).select("id", F.concat(F.lit("other-"), "id")))
    assert retrieval.exact_name_matches(p, many).isEmpty()


def test_exact_names_without_broadcasts(spark):
    """Names meet whole stretches of words: the same rows as by brute force, and neither names nor what prompts are exploded into is broadcast."""
    names = ["data tool", "tool", "data-tool", "(tool)", "c++ 11", "#!?#", "tools", "big data tool", "tool", "x\\\\Ey z", "über_maß"]
    prompts = ["a data tool", "datatool x", "the (tool) now", "(tool", "use c++ 11!", "so #!?# it", "a big  data_tool", "x\\\\Ey z", "ÜBER maß, tools", "", None, "?#!?#! tools"]
    cat = spark.createDataFrame(list(enumerate(names)), "doc_id long, name string")
    p = spark.createDataFrame(list(enumerate(prompts)), "prompt_id long, prompt string")
    plain = lambda x: re.sub(r"[\s_-]+", " ", x.lower()).strip(" ")
    holds = lambda x, n: re.search(rf"(^|[^\w]|_){re.escape(plain(n))}($|[^\w]|_)", plain(x))
    found = {i: [j for j, n in enumerate(names) if len(re.sub(r"[-_\s]", "", n)) >= 4 and holds(x, n)] for i, x in enumerate(prompts) if x}
    got = retrieval.exact_name_matches(p, cat)
    assert sorted(map(tuple, got.collect())) == sorted((i, js[0]) for i, js in found.items() if len(js) == 1) != []
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_budget_loader(spark):
    rows = [(1, 1, 10, 8, "h"), (1, 2, 11, 8, "h"), (1, 3, 12, 128, "g")]
    got = budget.greedy_budget(spark.createDataFrame(rows, "prompt_id long, rank int, doc_id long, tokens long, content_hash string"), 20).orderBy("rank").collect()
    assert [r.reason for r in got] == [None, "duplicate-content", "token-budget"]


def test_newest_notes_within_budget(spark):
    rows = [(1, i, 50) for i in range(5)]
    kept = budget.newest_first_budget(spark.createDataFrame(rows, "doc_id long, seq long, tokens long"), 120)
    assert {r.seq for r in kept.collect()} == {4, 3}


def test_sections(spark):
    body = "head\n## pdf tables\n" + "word " * 200 + "\n## other\n" + "thing " * 200
    df = spark.createDataFrame([(1, "pdf tables please", body), (2, "x", "no section")], "doc_id long, prompt string, body string")
    got = {r.doc_id: r for r in budget.select_sections(df, 400, 100).collect()}
    assert "pdf tables" in got[1].body and "## other" not in got[1].body and got[1].dropped == 1 and got[2].body == "no section"
    assert budget.select_sections(df, 400).where("dropped > 0").isEmpty()  # under the gate


def test_sections_keep_front_matter_and_pay_for_it(spark):
    head = "---\nname: x\n---\n"
    first = "  ## one\n" + "alpha " * 40
    rows = [(1, "beta", f"{head}{first}\n## two\n" + "beta " * 40 + "\n## three\ngamma"), (2, "beta", first + "\n## two\n" + "beta " * 40)]
    got = {r.doc_id: r for r in budget.select_sections(spark.createDataFrame(rows, "doc_id long, prompt string, body string"), 60, 10).collect()}
    assert got[1].body == head + "## two\n" + "beta " * 40 + "\n\n[2 sections omitted]" and got[1].dropped == 2
    assert got[2].body.startswith("## two") and got[2].dropped == 1  # a body may begin with a heading


def test_summary_tier(spark):
    ranked = spark.createDataFrame([(1, 20, d, s, r) for d, s, r in ((10, 9.0, 1), (11, 9.0, 2), (12, 9.0, 3), (13, 1.0, 4), (14, 1.0, 5))], "prompt_id long, now long, doc_id long, score double, rank int")
    pairs = lambda rows, more="": spark.createDataFrame(rows, "prompt_id long, doc_id long" + more)
    costs = spark.createDataFrame([(d, 100) for d in range(10, 20)], "doc_id long, tokens long")
    got = budget.summary_tier(ranked, pairs([(1, 13)]), pairs([(1, 12, 5), (1, 14, 15)], ", last long"), pairs([(1, 15, 1), (1, 12, 2), (1, 13, 3)], ", rank int"), costs, budget=250)
    assert [(r.doc_id, r.place, r.running) for r in got.orderBy("place").collect()] == [(12, 1, 100), (15, 2, 200)]


def test_token_accounting_refuses_unknown_documents(spark):
    cat = spark.createDataFrame([(1, 10, 100), (2, 10, 200)], "doc_id long, activation_tokens long, full_tokens long")
    good = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "task_id string, doc_id long, rank int")
    assert tuple(metrics.token_accounting(good, cat).first()) == (2, 20, 300, 40, -260, -6.5)
    with pytest.raises(Exception, match="1 predicted documents"):
        metrics.token_accounting(good.union(spark.createDataFrame([("c", 9, 1)], good.schema)), cat).collect()


def test_targeted_variants_and_pools(spark):
    ids = ["distractor/dist_gold_0a", "distractor/dist_gold_1b", "distractor/dist_other_2c", "plain"]
    got = sampling.targeted_variants(spark.createDataFrame([(i,) for i in ids], "doc_id string"), spark.createDataFrame([("gold",)], "doc_id string"), 5, "s")
    assert {r.doc_id for r in got.collect()} == set(ids[:2])
    pool = sampling.fill_pool(spark.range(3).select(F.col("id").alias("doc_id")), spark.range(50).select(F.col("id").alias("doc_id")), 10, "s").collect()
    assert len(pool) == 10 and {r.doc_id for r in pool if r.chosen} == {0, 1, 2} and len({r.doc_id for r in pool}) == 10


def test_sample_writer(spark, tmp_path):
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    grades = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 0.0), ("b", 9, 1.0), ("c", 1, 1.0)], "task_id string, doc_id long, relevance double")
    pool, chosen = spark.range(6).select(F.col("id").alias("doc_id")), spark.range(1, 4).select(F.col("id").alias("doc_id"))
    stats = sampling.write_sample(tasks, grades, pool, chosen, str(tmp_path / "s")).first()
    assert (stats.tasks, stats.pool, stats.required) == (2, 3, 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "s/grades")).select("task_id", "doc_id").collect()} == {("a", 1), ("a", 2)}
    with pytest.raises(ValueError):
        sampling.write_sample(tasks, grades, pool, spark.range(4, 9).select(F.col("id").alias("doc_id")), str(tmp_path / "t"))


def test_dedup_of_ranked_lists_and_cache_keys(spark):
    rows = [(1, 10, 5.0, "h"), (1, 11, 6.0, "h"), (1, 12, 1.0, "g"), (2, 10, 5.0, "h")]
    got = retrieval.dedup_by_content(spark.createDataFrame(rows, "prompt_id long, doc_id long, score double, content_hash string")).collect()
    assert {(r.prompt_id, r.doc_id) for r in got} == {(1, 11), (1, 12), (2, 10)}
    keys = vectors.cache_key(spark.createDataFrame([(1, 0, "h"), (1, 1, "h"), (2, 0, "h")], "doc_id long, position int, content_hash string"), "m").collect()
    assert len({r.key for r in keys}) == 3


def test_staleness(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 10)], "item long, last_injected long")
    assert [r.item for r in sessions.stale(df, F.lit(25)).collect()] == [1]


def test_ranked_metrics(spark):
    gold = spark.createDataFrame([("one", "good", 3.0), ("one", "close", 1.0), ("two", "x", 2.0), ("two", "y", 2.0)], "task_id string, doc_id string, relevance double")
    pred = spark.createDataFrame([("one", "bad", 1), ("one", "good", 2), ("one", "close", 3), ("two", "x", 1), ("two", "other", 2), ("two", "y", 3)], "task_id string, doc_id string, rank int")
    r = metrics.macro_mean(metrics.ranked_metrics(pred, gold, 3)).first()
    assert (r.cases, r.hit1, r.recall) == (2, 0.5, 1.0) and 0.5 < r.mrr < 1 and 0.5 < r["map"] < 1


def test_policy_orders(spark):
    rows = [(1, 1, 1, 2, 9, 1), (1, 2, 1, 29, 1, 2), (1, 3, 1, 28, 12, 3), (1, 4, 1, 30, 0, 4)]
    df = spark.createDataFrame(rows, "session long, item long, first_use int, last_use int, hits int, insert_seq int")
    order = lambda p: [r.item for r in sessions.restore_order(df, p).orderBy("place").collect() if r.item < 4]
    assert order("lru") == [2, 3, 1] and order("lfu") == [3, 2, 1]


def test_adaptive_lists():
    lists = live.AdaptiveLists(slots=2)
    for item in (1, 1, 2, 3):
        lists.use(item)
    assert lists.b1 == [2]
    lists.use(2)
    assert lists.p >= 1 and 2 in lists.t2


def test_associations(spark):
    rows = [(i, x) for i in range(3) for x in ("pdf", "tables")] + [(9, "unrelated")]
    got = sessions.associations(spark.createDataFrame(rows, "basket long, item string")).collect()
    assert {(r.a, r.b, r.confidence) for r in got} == {("pdf", "tables", 1.0), ("tables", "pdf", 1.0)}


def test_stratified_sample_size_and_partitions(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, "a").otherwise("b").alias("s"))
    got = [sorted(r.id for r in sampling.stratified_sample(d, "id", "s", 100, "x").collect()) for d in (df.coalesce(1), df.repartition(8))]
    assert len(got[0]) == 100 and got[0] == got[1]


def test_chunks(spark):
    text = "word " * 2000
    pieces = vectors.cut(text)
    assert len(pieces) == 3 and all(len(p) <= 4000 for p in pieces) and vectors.cut(None) == [""]
    cat = spark.createDataFrame([(1, "n", "d", text), (2, "n", "d", None)], "doc_id long, name string, description string, body string")
    assert vectors.manifest(vectors.chunks(cat)).where("doc_id = 1").first().chunks == 3


def test_encoder_and_scorer(spark):
    v = vectors.encode(spark.createDataFrame([("a b c",), (None,)], "text string"), vectors.hashing_encoder(8)).collect()
    assert abs(np.linalg.norm(v[0].embedding) - 1) < 1e-5
    pairs = spark.createDataFrame([("p", "b"), ("p", "bad")], "prompt string, body string")
    got = vectors.score_pairs(pairs, lambda: lambda a, b: [float("nan") if y == "bad" else 3.0 for y in b]).collect()
    assert [r.score for r in got] == [1.0]


def test_json_lines_and_layouts(spark, tmp_path):
    import gzip

    (tmp_path / "pool/sub").mkdir(parents=True)
    (tmp_path / "pool/a.jsonl").write_text('{"skill_id": "a", "name": "n", "desc": "d", "skill_md": "b"}\n\n')
    with gzip.open(tmp_path / "pool/sub/b.jsonl.gz", "wt") as f:
        f.write('{"id": "b", "name": "n", "description": "e", "body": "c"}\n')
    assert {tuple(r) for r in tables.pool(spark, str(tmp_path / "pool")).collect()} == {("a", "n", "d", "b"), ("b", "n", "e", "c")}
    (tmp_path / "relevance.json").write_text(json.dumps({"t": {"task_type": "x", "core_gt_ids": ["a"], "relevance": {"b": 2}}}))
    (tmp_path / "tasks.jsonl").write_text('{"task_id": "t", "instruction_text": "do"}\n')
    tasks, _, gold = tables.normalize_dataset(spark, str(tmp_path))
    assert tasks.count() == 1 and {tuple(r) for r in gold.collect()} == {("t", "a", 1.0), ("t", "b", 2.0)}


def test_flat_layout_and_splits(spark, tmp_path):
    for kind, line in (("queries", '{"id": "q", "query": "do"}'), ("qrels", '{"query_id": "q", "skill_id": "a", "relevance": 2}\n{"query_id": "q", "skill_id": "b", "relevance": 0}')):
        (tmp_path / f"data/{kind}").mkdir(parents=True)
        (tmp_path / f"data/{kind}/test.jsonl").write_text(line + "\n")
    (tmp_path / "pool").mkdir()
    (tmp_path / "pool/a.jsonl").write_text('{"id": "a", "name": "n", "description": "d", "body": "b"}\n')
    tasks, pool, gold = tables.normalize_dataset(spark, str(tmp_path))
    assert [tuple(r) for r in tasks.collect()] == [("q", "do")] and pool.count() == 1 and [tuple(r) for r in gold.collect()] == [("q", "a", 2.0)]
    assert tables.split_path(spark, str(tmp_path), "qrels", "test").endswith("data/qrels/test.jsonl")
    with pytest.raises(FileNotFoundError):
        tables.split_path(spark, str(tmp_path), "qrels", "train")


def test_trees_and_manifests(spark, tmp_path):
    deep = "/".join("abcdefghij")
    for at in ("one", "node_modules/two", deep):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "SKILL.md").write_text("---\ndescription: d\n---\ntext")
    got = {r.name: r.description for r in tables.document_tree(spark, str(tmp_path)).collect()}
    assert got == {"one": "d"}
    assert {r.name for r in tables.document_tree(spark, str(tmp_path), 20).collect()} == {"one", "j"}
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/q/good.json").write_text('{"name": "g"}')
    (tmp_path / "p/q/bad.json").write_text("{nothing")
    assert {(r.name, r.invalid) for r in tables.manifests(spark, str(tmp_path / "p")).collect()} == {("g", False), ("p", True)}


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.publish(spark.range(3), root, "1")
    tables.publish(spark.range(5), root, "2")
    (tmp_path / "t/version=3").mkdir()
    assert tables.published(spark, root).count() == 5


def test_the_version_completed_last_counts(spark, tmp_path):
    root = str(tmp_path / "t")
    for name, n in (("9", 9), ("10", 10), ("a", 1)):
        tables.publish(spark.range(n), root, name)
        assert tables.published(spark, root).count() == n


def test_an_encoder_that_fails_half_way(spark, tmp_path):
    root, items = str(tmp_path / "v"), spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    broken = F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 5  # fails in the sixth of eight shards
    vector = F.array(F.col("doc_id").cast("double"), F.lit(1.0))
    fails = lambda df: df.withColumn("embedding", F.when(broken, F.raise_error(F.lit("out of memory"))).otherwise(vector))
    with pytest.raises(Exception, match="out of memory"):
        tables.encode_shards(items, fails, root, "m", every=25)
    kept = spark.read.parquet(root)
    assert 0 < kept.count() < 200 and kept.select("part").distinct().count() == 5
    seen = []
    assert tables.encode_shards(items, lambda df: (seen.append(df.count()), df.withColumn("embedding", vector))[1], root, "m", every=25) >= 1
    assert sum(seen) == 200 - kept.count()
    held = spark.read.parquet(root)
    assert held.count() == held.select("doc_id").distinct().count() == 200 and tables.encode_shards(items, fails, root, "m") == 0
    with pytest.raises(Exception, match="another size"):
        tables.encode_shards(spark.range(300, 310).select(F.col("id").alias("doc_id")), lambda df: df.withColumn("embedding", F.array(F.lit(1.0))), root, "m")


def test_a_retried_batch_adds_no_row(spark, tmp_path):
    items = spark.range(10).select(F.col("id").alias("doc_id"))
    items.coalesce(1).write.parquet(str(tmp_path / "in"))
    encode = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))
    for state in ("a", "b"):  # another checkpoint: batch 0 is run again
        stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
        tables.shard_stream(stream, encode, str(tmp_path / "v"), "m", str(tmp_path / state)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 10


def test_predictions_follow_the_published_rules(spark, tmp_path):
    rule = lambda b: spark.createDataFrame([(1, b, 3, 0.5, 1)], "a long, b long, support long, confidence double, rank int")
    selected = lambda k: spark.createDataFrame([(k, 1)], "key long, item long")
    root, out = str(tmp_path / "rules"), str(tmp_path / "out")
    for k, b in ((1, 20), (2, 30)):
        tables.publish(rule(b), root, str(k))
        selected(k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key long, item long").parquet(str(tmp_path / "in"))
        tables.predict_stream(stream, root, out, str(tmp_path / "c")).awaitTermination(120)
    assert {(r.key, r.item) for r in spark.read.option("recursiveFileLookup", True).parquet(out).collect()} == {(1, 20), (2, 30)}


def test_near_ties_by_depth_and_reranker(spark):
    """Two documents within the margin: both are given if two are asked for, none for one without a reranker, the better one with it."""
    prompts = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "alpha", [0.0, -1.0]), (3, "gamma words", None)], "prompt_id long, prompt string, embedding array<double>")
    pool = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.02]), (3, [1.0, 1.03])], "doc_id long, embedding array<double>")
    cat = spark.createDataFrame([(1, "one", "first", "same text", 5), (2, "two", "second", "same text", 5), (3, "three", "gamma", "alpha beta text", 5)], "doc_id long, name string, description string, body string, activation_tokens long")
    go = lambda top, reranker: sorted((r.prompt_id, r.rank, r.doc_id, r.method) for r in retrieval.route(prompts, cat, top, "hybrid", pool, reranker=reranker).collect())
    fallback = (3, 1, 3, "lexical")
    assert go(2, "none") == [(1, 1, 1, "semantic"), (1, 2, 3, "semantic"), fallback]  # the copy of the first is left out; prompt 2 is under the floor
    assert go(1, "none") == [fallback] and go(1, "similarity") == [(1, 1, 3, "semantic"), fallback]


def test_copies_of_a_text_are_not_handed_on(spark, monkeypatch):
    """The search keeps the best of each text itself: 300 copies do not make every list 300 times as long."""
    rng = np.random.default_rng(4)
    n = 600
    vectors, body = rng.normal(size=(n, 8)), ["copy" if i % 2 else f"text {i % 400}" for i in range(n)]
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<float>").repartition(4)
    cat = spark.createDataFrame(list(enumerate(body))[: n - 3], "doc_id long, body string")
    asked = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(30)], "prompt_id long, embedding array<double>")
    tops, near = [], retrieval.vector_top
    monkeypatch.setattr(retrieval, "vector_top", lambda q, p, top, floor: tops.append(top) or near(q, p, top, floor))
    unit = lambda m: m / np.sqrt((m * m).sum(1))[:, None]
    score = np.round(unit(np.array([r.embedding for r in asked.orderBy("prompt_id").collect()])) @ unit(vectors.astype(np.float32).astype(np.float64)).T, 9)
    want = []
    for k in range(30):
        seen, rank = set(), 0
        for i in sorted(range(n), key=lambda i: (-score[k, i], i)):
            text = body[i] if i < n - 3 else i
            if text not in seen and rank < 5 and score[k, i] >= 0.1:
                seen.add(text)
                rank += 1
                want.append((k, i, rank))
    for block in (4096, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got = retrieval.semantic_list(asked, pool, cat, 2, 0.1, depth=5).orderBy("prompt_id", "rank").collect()
        assert [(r.prompt_id, r.doc_id, r.rank) for r in got] == want
    assert tops == [5, 5]


def test_vector_shards_resume(spark, tmp_path):
    root, all_ = str(tmp_path / "v"), spark.range(10).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    tables.append_shards(all_.where("doc_id < 4"), root, "m1")
    tables.append_shards(all_, root, "m1")
    tables.append_shards(all_.where("doc_id < 2"), root, "m2")
    held = spark.read.parquet(root)
    assert tuple(tables.shard_progress(held, all_, "m1").first()) == (10, 2, 10) and held.where("fingerprint = 'm2'").count() == 2


def test_reports_replace_only_their_own(spark, tmp_path):
    root = str(tmp_path / "r")
    for name, n in (("a b", 1), ("other", 2), ("a b", 3)):
        tables.write_report(spark.range(n, n + 1), root, name, "p 1")
    assert {(r.id, r.benchmark, r.partition) for r in spark.read.parquet(root).collect()} == {(3, "a-b", "p-1"), (2, "other", "p-1")}


def test_stream_equals_batch(spark, tmp_path):
    events = plans.session_events(spark, "/root/testdata/sf0.001").where("session < 8")
    events.repartition(1).sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.forceDeleteTempCheckpointLocation", True)
    tables.append_trace(live.trace_stream(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    key = lambda r: (r.session, r.event_id)
    ours = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key)
    batch = sorted(live.trace_batch(events).collect(), key=key)
    assert batch and ours == batch


def test_ends_and_legacy_states(spark):
    legacy = live.from_legacy(spark.createDataFrame([(1, [7, 8])], "session long, ids array<long>"))
    more = spark.createDataFrame([(1, "prompt", 1, [7], None), (1, "end", 2, None, None), (1, "prompt", 3, [7], None)], "session long, event string, event_id long, selected array<long>, budget int").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    trace = live.trace_batch(legacy.unionByName(more, allowMissingColumns=True))
    got = trace.orderBy("event_id").collect()
    assert [(r.injected, r.deduplicated, r.now) for r in got] == [([7, 8], [], 1), ([], [7], 2), ([], [], 2), ([7], [], 1)]
    assert {(r.item, r.since) for r in live.residents(trace).collect()} == {(7, 1)}


def _drained(spark, frame, tmp_path, name):
    """One run over all that is there: what the sink has then."""
    tables.append_trace(frame, str(tmp_path / "out" / name), str(tmp_path / "state" / name)).awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / name)).collect()), key=lambda r: (r[0], r[1]))


def _written(events, path, k):
    events.coalesce(1).write.mode("append").parquet(str(path / "in" / str(k)))


def _stream(spark, events, path):
    return spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def test_state_over_batches_and_a_restart(spark, tmp_path):
    """Several micro-batches, then a second run from the checkpoint with more input; memo, summaries and compactions included."""
    events = plans.session_events(spark, "/root/testdata/sf0.001").where("session < 6").withColumn("prompt_key", F.when(F.col("event") == "prompt", F.concat(F.lit("k"), F.col("event_id") % 7)))
    events = events.withColumn("offered", F.transform("selected", lambda x: (x + 1) % 50)).withColumn("offered", F.col("offered").cast("array<long>"))
    events = events.withColumn("budget", F.when(F.col("event") == "compact", 3))
    rows = [r.event_id for r in events.orderBy("ts", "event_id").select("event_id").collect()]
    cuts = [rows[len(rows) * k // 4 : len(rows) * (k + 1) // 4] for k in range(4)]
    batch = sorted(map(tuple, live.trace_batch(events).collect()), key=lambda r: (r[0], r[1]))
    for k, ids in enumerate(cuts[:3]):
        _written(events.where(F.col("event_id").isin(ids)), tmp_path, k)
    first = _drained(spark, live.trace_stream(_stream(spark, events, tmp_path)), tmp_path, "a")
    assert len(first) == sum(map(len, cuts[:3]))
    _written(events.where(F.col("event_id").isin(cuts[3])), tmp_path, 3)
    assert _drained(spark, live.trace_stream(_stream(spark, events, tmp_path)), tmp_path, "a") == batch
    assert any(r[-1] for r in batch) and any(r[-2] for r in batch) and any(r[8] for r in batch)


def test_state_begins_with_legacy_lists(spark, tmp_path):
    legacy = spark.createDataFrame([(1, [7, 8]), (2, [])], "session long, ids array<long>")
    events = spark.createDataFrame([(s, "prompt", t, t + 10 * s, [7, t], None) for s in (1, 2, 3) for t in (1, 2)] + [(1, "compact", 3, 19, None, 2)], "session long, event string, t long, event_id long, selected array<long>, budget int").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    _written(events, tmp_path, 0)
    got = _drained(spark, live.trace_stream(_stream(spark, events, tmp_path), legacy=legacy), tmp_path, "b")
    batch = sorted(map(tuple, live.trace_batch(live.from_legacy(legacy).unionByName(events)).where("event <> 'legacy'").collect()), key=lambda r: (r[0], r[1]))
    assert got == batch and [r[5] for r in got if r[0] == 1] == [[7], [7], []]


def test_idle_sessions_end_by_timer(spark, tmp_path):
    events = spark.createDataFrame([(1, "prompt", 1, [7], None)], "session long, event string, event_id long, selected array<long>, budget int").withColumn("ts", F.timestamp_seconds("event_id"))
    _written(events, tmp_path, 0)
    frame = live.trace_stream(_stream(spark, events, tmp_path), idle_ms=1000, ttl_ms=3_600_000)
    at = str(tmp_path / "out")
    query = frame.writeStream.format("parquet").option("path", at).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    told = lambda: {(r.session, r.event_id, r.event, r.now) for r in (spark.read.parquet(at).collect() if tables.exists(spark, at + "/_spark_metadata/0") else [])}

    def wait(row):
        end = time.time() + 60
        while row not in told() and time.time() < end and query.isActive:
            time.sleep(0.5)
        assert row in told()

    try:
        wait((1, -1, "end", 1))
        _written(events.withColumn("event_id", F.lit(5).cast("long")), tmp_path, 1)
        wait((1, 5, "prompt", 1))  # the state is gone: the clock begins anew
    finally:
        query.stop()


def test_prompt_memo():
    s = live.Session()
    say = lambda k, ids: s.step("prompt", ids, None, None, f"k{k}")
    for k in range(32):
        say(k, [k])
    again = say(0, None)
    assert again["recalled"] and again["deduplicated"] == [0]  # and the key is now the latest
    assert not say(32, [32])["recalled"] and len(s.memo) == 32
    assert not say(1, [77])["recalled"] and say(0, [99])["deduplicated"] == [0]
    assert say(1, None)["deduplicated"] == [77]


def test_summaries_are_spaced():
    s = live.Session()
    told = [s.step("prompt", [1], None, [1, 2])["summarized"] for _ in range(12)]
    assert told == [[2]] + [[]] * 9 + [[2], []] and live.Session(s.dump()).shown == {2: 11}


def test_routing_a_stream_into_sessions(spark, tmp_path):
    """Prompts on a stream are routed in micro-batches; the selections feed the sessions' state; both equal the batch."""
    prompts, cat = plans._prompts(spark, "/root/testdata/sf0.001"), plans._catalog(spark, "/root/testdata/sf0.001")

    def events(batch):
        found = retrieval.lexical_top(batch, cat, 5).groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
        ids = lambda a, b: F.transform(F.filter("x", lambda r: r["rank"].between(a, b)), lambda r: r["doc_id"])
        held = batch.join(found, "prompt_id", "left").select(F.col("conv_id").alias("session"), F.lit("prompt").alias("event"), F.timestamp_seconds("turn").alias("ts"), F.col("prompt_id").alias("event_id"), ids(1, 2).alias("selected"), F.lit(None).cast("int").alias("budget"), ids(3, 5).alias("offered"))
        return held

    for k in range(2):
        prompts.where(F.floor(F.col("turn") / 4) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(prompts.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tables.route_stream(stream, events, str(tmp_path / "routed"), str(tmp_path / "c1")).awaitTermination()
    key = lambda r: (r.session, r.event_id)
    routed = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "routed"))
    assert sorted(routed.collect(), key=key) == sorted(events(prompts).collect(), key=key)
    again = spark.readStream.schema(routed.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "routed"))
    tables.append_trace(live.trace_stream(again), str(tmp_path / "trace"), str(tmp_path / "c2")).awaitTermination()
    batch = sorted(live.trace_batch(events(prompts)).collect(), key=key)
    assert sorted(spark.read.parquet(str(tmp_path / "trace")).collect(), key=key) == batch and any(r.summarized for r in batch)


def test_refresh_clock():
    s = live.Session()
    s.step("prompt", [1], None)
    for _ in range(19):
        s.step("prompt", [], None)
    assert s.step("prompt", [1], None)["refreshed"] == [1] and s.step("prompt", [1], None)["refreshed"] == []


def test_lexical_blocks_and_names(spark, monkeypatch):
    cat, prompts = plans._catalog(spark, "/root/testdata/sf0.001"), plans._prompts(spark, "/root/testdata/sf0.001")
    prompts = prompts.unionByName(prompts.limit(3).withColumn("prompt_id", F.col("prompt_id") + 10**6)).unionByName(cat.limit(2).select((F.col("doc_id") + 2 * 10**6).alias("prompt_id"), F.lit(0).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.concat(F.lit("say "), "name", F.lit(" now")).alias("prompt")))
    key = lambda r: (r.prompt_id, r.rank)
    one = sorted(retrieval.lexical_top(prompts, cat, 3).collect(), key=key)
    assert any(r.prompt_id >= 2 * 10**6 and r.score >= 12 for r in one)
    monkeypatch.setattr(index, "BLOCK", 10)
    monkeypatch.setattr(index, "SHARD", (30, 30))
    held = index.build(cat.repartition(5))
    assert held.shards > 5 and sorted(retrieval.lexical_top(prompts, held, 3).collect(), key=key) == one
    assert retrieval.lexical_top(prompts.limit(0), held).collect() == [] and retrieval.lexical_top(prompts, cat.limit(0)).collect() == []


def test_pruned_search_by_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(400):
        monkeypatch.setattr(index, "SEEDS", int(rng.integers(0, 60)))
        lists = [np.unique(rng.integers(0, 200, size=int(2 ** rng.integers(0, 9)))) for _ in range(rng.integers(1, 12))]
        weights, tie = rng.choice([2.0, 6.0, 12.0, 0.5], size=len(lists)), rng.integers(0, 3, size=200)
        scores = {}
        for docs, w in zip(lists, weights, strict=True):
            for d in docs.tolist():
                scores[d] = scores.get(d, 0) + w
        for top, floor in ((1, 2), (3, 2), (10, 9)):
            want = sorted((-s, tie[d], d) for d, s in scores.items() if s >= floor)[:top]
            got = index._best(lists, weights, top, floor, lambda d: tie[d])
            assert [(-s, d) for d, s in zip(*got, strict=True)] == [(s, d) for s, _, d in want]


def test_summed_lists_by_brute_force(monkeypatch):
    """Cells of short and long lists, of more weight than a byte holds and of many ties, with and without rows of bytes."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        monkeypatch.setattr(index, "DENSE", int(rng.choice([0, 2000, 10**6])))
        docs = rng.choice(10_000, size=int(rng.choice([3, 300, 700])), replace=False) - 500
        tie = dict(zip(docs.tolist(), rng.integers(-1, 3, size=len(docs)).tolist(), strict=True))
        lists = {int(4 * i + f): np.sort(rng.choice(docs, size=rng.integers(1, len(docs) + 1), replace=False)) for i in range(30) for f in (0, 1, 3)}
        weights = [6, 2, 0, 12] if trial % 3 else [300, 2, 0, 12] if trial % 2 else [6, 0.5, 0, 12]
        asked = {p: rng.choice([*lists, 402, 403], size=rng.integers(1, 70), replace=False).tolist() for p in range(5)}
        held = pa.table({"id": pa.array([*lists, None], pa.int64()), "docs": pa.array([*lists.values(), docs], pa.list_(pa.int64())), "ties": pa.array([*([None] * len(lists)), [tie[d] for d in docs.tolist()]], pa.list_(pa.int64()))})
        for top, floor in ((1, 2), (5, 2), (400, 9)):
            got = index._cell(top, floor, weights)(pa.table({"p": list(asked), "ids": pa.array(list(asked.values()), pa.list_(pa.int64()))}), held).to_pylist()
            want = []
            for p, ids in asked.items():
                scores = {d: sum(weights[i & 3] for i in ids if i in lists and d in members[i]) for members in [{i: set(x.tolist()) for i, x in lists.items()}] for d in docs.tolist()}
                want += [(p, d, s) for s, _, d in sorted((-s, tie[d], d) for d, s in scores.items() if s >= floor)[:top]]
            assert [(r["p"], r["doc_id"], -r["score"]) for r in got] == want


def test_cells_leave_what_cannot_win():
    """Given the score and tie to beat, a cell answers with nothing less, loses nothing that beats them, and has no rows where nothing does."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        docs = np.sort(rng.choice(10_000, size=int(rng.choice([3, 300, 700])), replace=False))
        tie = rng.integers(0, 4, size=len(docs))
        lists = {int(4 * i + f): np.sort(rng.choice(docs, size=rng.integers(1, len(docs) + 1), replace=False)) for i in range(30) for f in (0, 1)}
        asked = pa.table({"p": list(range(5)), "ids": pa.array([rng.choice([*lists, 402], size=rng.integers(1, 40), replace=False).tolist() for _ in range(5)], pa.list_(pa.int64()))})
        held = pa.table({"id": pa.array([*lists, None], pa.int64()), "docs": pa.array([*lists.values(), docs], pa.list_(pa.int64())), "ties": pa.array([*([None] * len(lists)), tie.tolist()], pa.list_(pa.int64()))})
        least, last = rng.integers(2, 60, size=5).astype(float), rng.integers(-1, 5, size=5)
        run = index._cell(5, 2, [6, 2, 0, 12])
        beats = lambda r: (r["score"], -r["tie"]) >= (least[r["p"]], -last[r["p"]])  # noqa: E731, B023
        got = run(asked.append_column("least", pa.array(least)).append_column("tie", pa.array(last)), held).to_pylist()
        assert [r for r in got if beats(r)] == [r for r in run(asked, held).to_pylist() if beats(r)] and all(r["score"] >= least[r["p"]] for r in got)
        asked = asked.append_column("least", pa.array([500.0] * 5)).append_column("tie", pa.array([0] * 5))
        assert run(asked, held).num_rows == 0


def test_shards_hold_neighbours_and_are_searched_in_rounds(spark, monkeypatch):
    """Documents of a provider share shards; whatever the shards and rounds, the answers are the same, ties included."""
    monkeypatch.setattr(index, "SHARD", (20, 20))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), F.col("id") % 4).alias("provider"), F.lit("").alias("name"), F.concat_ws(" ", F.lit("alpha"), F.concat(F.lit("w"), F.col("id") % 4), F.concat(F.lit("x"), F.col("id") % 7)).alias("description"), (F.col("id") % 3).alias("activation_tokens"))
    held = index.build(docs)
    of = docs.select("doc_id", "provider").join(held.table("documents"), "doc_id").groupBy("shard").agg(F.count_distinct("provider").alias("n")).collect()
    assert held.shards == 20 and sum(r.n > 1 for r in of) <= 3
    for shards in (*range(1, 10), 16, 20, 64, 65):
        rounds = index._rounds(shards)
        assert sorted(sum(rounds, [])) == list(range(shards)) and (shards < 4 or len(rounds[0]) * 4 <= shards + 12)
    asked = spark.range(28).select(F.col("id").alias("prompt_id"), F.concat_ws(" ", F.lit("alpha"), F.concat(F.lit("w"), F.col("id") % 4), F.concat(F.lit("x"), F.col("id") % 7)).alias("prompt"))
    got = {(r.prompt_id, r.rank): (r.doc_id, r.score) for r in index.search(asked, held, 6, 2, [6, 2, 0, 12]).collect()}
    score = lambda p, d: 2.0 + 2.0 * (p % 4 == d % 4) + 2.0 * (p % 7 == d % 7)
    want = {(p, k + 1): (d, score(p, d)) for p in range(28) for k, d in enumerate(sorted(range(400), key=lambda d: (-score(p, d), d % 3, d))[:6])}
    assert got == want


def test_frequent_lists_are_not_sent_to_every_few_prompts(spark):
    """A block is tens of thousands of prompts and a shard tens of thousands of documents: the lists are sent as often as there are blocks."""
    assert index.BLOCK >= 32_768 and index.SHARD[0] >= 16_384
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("name"), F.lit("alpha beta gamma").alias("description"), F.col("id").alias("activation_tokens"))
    held = index.build(docs)
    prompts = spark.range(5000).select(F.col("id").alias("prompt_id"), F.concat(F.lit("gamma word"), "id").alias("prompt"))
    got = index.search(prompts, held, 1, 2, [6, 2, 0, 12])
    assert held.shards == 1 and got.select("doc_id", "score", "matches").distinct().collect() == [(0, 2.0, "gamma")] and got.count() == 5000


def test_lists_are_places_and_texts_are_stored_once(spark):
    """Lists cost four bytes a document, and a text is not sent beside its hash for every document that has it."""
    docs = spark.range(500).select((F.col("id") * 10**12).alias("doc_id"), F.lit("").alias("name"), F.lit("").alias("description"), (F.col("id") % 7).alias("activation_tokens"), F.concat(F.lit("alpha w"), F.col("id") % 50).alias("body"))
    held = index.build(docs, body=True)
    lists = held.table("postings").where("id is not null")
    assert lists.schema["docs"].dataType.simpleString() == "array<int>" and held.table("lists").count() == 51
    assert lists.agg(F.sum(F.size("docs")), F.max(F.size("docs"))).first()[:] == (1000, 500)
    asked = spark.createDataFrame([(1, "alpha"), (2, "w49 alpha"), (3, "nothing")], "prompt_id long, prompt string")
    got = index.search(asked, held, 2, 1, [6, 2, 1, 12]).orderBy("prompt_id", "rank").collect()
    assert [(r.prompt_id, r.doc_id // 10**12, r.score, r.matches) for r in got] == [(1, 0, 1.0, "alpha"), (1, 7, 1.0, "alpha"), (2, 49, 2.0, "alpha w49"), (2, 399, 2.0, "alpha w49")]


def test_names_of_all_shapes_by_brute_force(spark):
    """Names of one and more words, of marks only, with marks at their ends, inside longer words, beyond the basic plane."""
    rng = np.random.default_rng(5)
    bits = ["ab", "b", "abcdef", "-", "--", " ", ".", "é", "\U00010400", "x1"]
    word = lambda: "".join(rng.choice(bits, size=rng.integers(1, 6)))
    names, said = sorted({word().lower() for _ in range(300)}), {i: "".join(word() for _ in range(4)).lower() for i in range(80)}
    entries = spark.createDataFrame([(i, n, "", 0) for i, n in enumerate(names)], "doc_id long, name string, description string, activation_tokens long")
    asked = spark.createDataFrame(list(said.items()), "p long, said string")
    held = index.build(entries).table("names")
    texts = {r.id: r.text for r in held.collect()}
    got = {(r.p, texts[r.id]) for r in index._phrases(asked, held).collect()}
    assert got == {(p, n) for p, text in said.items() for n in names if n in text} and len(got) > 1000


def test_a_search_is_run_once(spark, monkeypatch):
    """The answers are stored: their plan has no cells, however often it is read, and the work tables are gone; modes share a list."""
    builds = []
    build = index.build
    monkeypatch.setattr(index, "build", lambda *a, **b: builds.append(build(*a, **b)) or builds[-1])
    cat, prompts = plans._catalog(spark, "/root/testdata/sf0.001"), plans._prompts(spark, "/root/testdata/sf0.001").limit(20)
    found = retrieval.lexical_top(prompts, cat, 3)
    plan = found.union(found)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and found.count() > 20
    path = spark._jvm.org.apache.hadoop.fs.Path(builds[0].root)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert plans.routing_modes(spark, "/root/testdata/sf0.001").count() > 0 and len(builds) == 2


def test_a_large_table_of_prompts(spark):
    """100,000 prompts cut from texts; a sample of them against a plain version."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cat = catalog.from_documents(docs)
    cuts = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")).select((F.col("doc_id") * 100 + F.col("k")).alias("prompt_id"), F.expr("substr(text, 1 + k * 7, 90)").alias("prompt"))
    assert cuts.count() == 100_000
    found = retrieval.lexical_top(cuts, cat, 2).select("prompt_id", "rank", "doc_id", "score").toPandas()
    assert len(found) > 100_000
    got = {(r.prompt_id, r.rank): (r.doc_id, r.score) for r in found.itertuples()}
    words = lambda df, c: F.array_distinct(tx.tokenize(F.col(c)))
    entries = [(r.doc_id, r.activation_tokens, r.name.lower(), set(r.n), set(r.d)) for r in cat.select("doc_id", "activation_tokens", "name", words(cat, "name").alias("n"), words(cat, "description").alias("d")).collect()]
    asked = cuts.where("prompt_id % 1999 = 0").select("prompt_id", "prompt", words(cuts, "prompt").alias("t")).collect()
    for r in asked:
        said, t = (r.prompt or "").lower(), set(r.t or [])
        scored = [(-(6 * len(t & n) + 2 * len(t & d) + 12 * bool(name and name in said)), tie, i) for i, tie, name, n, d in entries] if t else []
        want = [(i, float(-s)) for s, _, i in sorted(scored)[:2] if s <= -2]
        assert [got.get((r.prompt_id, k + 1)) for k in range(2)] == (want + [None, None])[:2]


def test_whole_texts_are_searchable(spark):
    cat = catalog.from_documents(spark.createDataFrame([(1, "word " * 200 + "zanzibar"), (2, "other text"), (3, None)], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")))
    asked = spark.createDataFrame([(1, "where is zanzibar"), (2, None), (3, "")], "prompt_id long, prompt string")
    assert retrieval.lexical_top(asked, cat).collect() == []
    assert [(r.prompt_id, r.doc_id, r.score, r.matches) for r in retrieval.lexical_top(asked, cat, body_weight=2).collect()] == [(1, 1, 2.0, "zanzibar")]


def test_bodies_are_cut_once_for_the_blend(spark):
    """A body is cut into terms before it meets its candidates, and no join comes after that, so no text is shuffled for each candidate."""
    prompts = spark.createDataFrame([(p, f"alpha alpha beta w{p} testing") for p in range(20)] + [(20, None)], "prompt_id long, prompt string")
    cat = spark.createDataFrame([(1, "Alpha tested alpha W3"), (2, None)], "doc_id long, body string")
    held = prompts.select("prompt_id").crossJoin(cat.select("doc_id")).withColumn("score", F.lit(0.2))
    found = retrieval.rerank_blend(held, prompts, cat, 2)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("regexp_extract_all" in x for x in lines[: next(i for i, x in enumerate(lines) if "Join" in x)])
    got = {(r.prompt_id, r.doc_id): r.score for r in found.collect()}
    assert len(got) == 42 and got[3, 1] == round(0.17 + 0.15 * 3 / 4, 9) and got[4, 1] == round(max(0.2, 0.17 + 0.15 * 2 / 4), 9) and got[4, 2] == got[20, 1] == 0.2
    assert one(spark, "Tests test testing a the boxes box é1", tx.term_set) == list(dict.fromkeys(one(spark, "Tests test testing a the boxes box é1", tx.tokenize)))


def test_rerank_by_a_model(spark):
    prompts = spark.createDataFrame([(1, "p")], "prompt_id long, prompt string")
    cat = spark.createDataFrame([(1, "short"), (2, "a longer body")], "doc_id long, body string")
    held = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1)], "prompt_id long, doc_id long, score double")
    order = lambda mode, load=None: [r.doc_id for r in retrieval.rerank(held, prompts, cat, 2, mode, load).orderBy("rank").collect()]
    assert order("none") == [1, 2] and order("model", lambda: lambda a, b: [len(x) / 100 for x in b]) == [2, 1]
    with pytest.raises(ValueError):
        retrieval.rerank(held, prompts, cat, 2, "model")


@pytest.mark.parametrize("name", ["lexical_top2", "exact_name", "greedy_budget", "ranked_metrics", "association_rules", "method_histogram", "single_gold_groups", "section_selection", "summary_tier", "hybrid_decision", "turn_metrics", "suite_violations", "catalog_fingerprint"])
def test_against_sql(spark, name):
    import verify

    assert verify.compare(spark, "/root/testdata/sf0.001", [name]) == 0


def test_ranks_over_ranges(spark, monkeypatch):
    """Ranges of a few rows each, ties over their borders, groups of one value, of nulls only and of a null key."""
    monkeypatch.setattr(metrics, "RANGE_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(None if i % 5 == 0 else f"k{i % 4}", float(rng.integers(40)) if i % 3 else float(rng.normal())) for i in range(600)]
    rows += [("one", 2.0)] * 30 + [("none", None)] * 3 + [("k1", None)]
    got = {r.k: (r.p50, r.p95, r.longest) for r in metrics.latency(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    for k in {k for k, _ in rows}:
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert got.pop(k) == ((v[-(-len(v) // 2) - 1], v[-(-len(v) * 95 // 100) - 1], v[-1]) if v else (None, None, None))
    assert not got
    assert metrics.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "v", [], {"low": 0.0}).first().low == min(x for _, x in rows if x is not None)
    assert metrics.latency(spark.createDataFrame([], "k string, v double"), "v", "k").count() == 0


@pytest.mark.parametrize("support", [1, 2])
def test_large_baskets_are_split(spark, support):
    rng = np.random.default_rng(8)
    rows = [(0, i) for i in range(300)] + [(1 + int(b), int(i)) for b, i in zip(rng.integers(40, size=800), rng.integers(320, size=800), strict=True)] + [(None, 1), (3, None), (0, 5)]
    df = spark.createDataFrame(rows, "basket long, item long")
    held = {}
    for b, i in rows:
        if b is not None and i is not None:
            held.setdefault(b, set()).add(i)
    want = Counter((x, y) for items in held.values() for x in items for y in items if x != y)
    for cut in (7, 10_000):
        got = {(r.a, r.b): r.support for r in sessions.pair_counts(df, support, cut).collect()}
        assert got == {p: n for p, n in want.items() if n >= support}


def test_incomplete_inputs_are_errors(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"))
    with pytest.raises(ValueError, match="27 documents are needed"):
        sampling.deal_blocks(docs, 3, "s")
    first, second = (sampling.deal_blocks(docs, 1, "s", block=k) for k in (0, 1))
    assert first.count() == second.count() == 9 and first.join(second, "doc_id").count() == 0
    core = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3"))
    assert sampling.required_in_pool(core, docs, 3).count() == 3
    with pytest.raises(ValueError, match="3 documents are required, the budget is 2"):
        sampling.required_in_pool(core, docs, 2)
    with pytest.raises(ValueError, match="1 required documents are not in the pool"):
        sampling.required_in_pool(core, docs.where("doc_id <> 1"), 9)
    pool = spark.createDataFrame([(f"distractor/dist_gold_{i:x}",) for i in range(6)] + [("distractor/dist_other_1",)], "doc_id string")
    gold = spark.createDataFrame([("gold",), ("gold",)], "doc_id string")
    assert [tuple(sampling.variant_counts(pool, gold, n).first()) for n in (4, 9)] == [(6, 4, 2), (6, 6, 0)]


def test_tail_leaves_old_days_unread(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [(i, f"2024-03-{1 + i // 4:02d} 0{i % 4}:00:00") for i in range(16)] + [(99, None)]
    spark.createDataFrame(events, "event_id long, at string").select("event_id", F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "trace")
    tables.append_daily_trace(stream, path, str(tmp_path / "state")).awaitTermination(120)
    for old in (tmp_path / "trace" / "day=2024-03-01").glob("*.parquet"):
        old.write_bytes(b"not a table")
    assert [r.event_id for r in tables.tail(spark, path, 6).collect()] == [10, 11, 12, 13, 14, 15]
    assert [r.event_id for r in tables.tail(spark, path, 12).collect()] == list(range(4, 16))
    with pytest.raises(Exception, match="(?i)parquet"):
        tables.tail(spark, path, 13).collect()
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.tail(spark, str(tmp_path / "empty"))


def test_tree_fingerprint(spark, tmp_path):
    def print_of(files):
        root = tmp_path / f"tree{len(list(tmp_path.iterdir()))}"
        for name, body in files.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_bytes(body)
        return tables.tree_fingerprint(spark, str(root)).first()[0], root

    tree = {"a.txt": b"one", "sub/b.txt": b"two", "sub/deep/c.bin": bytes(range(256)) * 40}
    base, root = print_of(tree)
    assert print_of(dict(reversed(tree.items())))[0] == base == tables.tree_fingerprint(spark, f"file://{root}").first()[0]
    changed = [{**tree, "a.txt": b"onf"}, {**{k: v for k, v in tree.items() if k != "a.txt"}, "z.txt": b"one"}, {**{k: v for k, v in tree.items() if k != "a.txt"}, "sub/a.txt": b"one"}, {k: v for k, v in tree.items() if k != "a.txt"}]
    assert len({base, *(print_of(t)[0] for t in changed)}) == 5
    sums = [0] * 8
    for name, body in tree.items():
        row = hashlib.sha256("\x1f".join([name, str(len(body)), hashlib.sha256(body).hexdigest()]).encode()).hexdigest()
        sums = [s + int(row[8 * i : 8 * i + 8], 16) for i, s in enumerate(sums)]
    assert base == hashlib.sha256(",".join(map(str, [*sums, len(tree)])).encode()).hexdigest()


def test_prompt_to_context(spark):
    """Sections are cut before notes are added, notes count in the cost; stale residents, predictions and prompts without anything."""
    long = "# Guide\nintro\n## Apples\n" + "apple " * 60 + "\n## Pears\n" + "pear " * 60
    cat = spark.createDataFrame([(1, 'a "b"', "p", "first", long), (2, "two", "p", "second", "# Head\nshort"), (3, "three", "p", "third", None), (4, "four", "p", "fourth", "x " * 50), (5, None, None, None, "y")], "doc_id long, name string, provider string, description string, body string")
    prompts = spark.createDataFrame([(1, "pear trees"), (2, "again"), (3, None)], "prompt_id long, prompt string")
    ranked = spark.createDataFrame([(1, 1, 1, 9.0, 1), (1, 1, 4, 8.0, 2), (1, 1, 3, 1.0, 3), (2, 2, 2, 9.0, 1), (2, 2, 5, 3.0, 2), (2, 2, 1, 2.5, 3)], "prompt_id long, now long, doc_id long, score double, rank int")
    residents = spark.createDataFrame([(2, 2, True), (2, 4, True), (2, 2, False)], "prompt_id long, doc_id long, stale boolean")
    shown = spark.createDataFrame([(2, 1, 1)], "prompt_id long, doc_id long, last long")
    predicted = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "prompt_id long, doc_id long, rank int")
    notes = spark.createDataFrame([(1, "## Note kept")], "doc_id long, overlay string")
    run = lambda tokens: {r.prompt_id: r for r in context.prompt_context(prompts, ranked, cat, residents, shown, predicted, notes, token_budget=tokens, gate=50, section_budget=95).collect()}
    got = run(1000)
    assert [got[n].loaded for n in (1, 2, 3)] == [[1, 4], [5], []] and [got[n].restated for n in (1, 2, 3)] == [[], [2], []]
    assert [got[n].offered for n in (1, 2, 3)] == [[3, 2], [], []] and got[3].context == "" and got[3].tokens == 0 and not got[1].skipped
    text = got[1].context
    assert text.startswith('<document name="a &quot;b&quot;" provider="p">\n# Guide') and "## Pears" in text and "## Apples" not in text and "\n\n## Note kept\n</document>" in text
    assert '<document-available name="two" provider="p">\nsecond\nSections: Head\n</document-available>' in text
    assert got[2].context == '<document name="" provider="">\ny\n</document>\n\n<document-again name="two" provider="p">\nsecond\nSections: Head\n</document-again>'
    first = one(spark, text.split("\n</document>")[0].split('">\n', 1)[1], tx.estimate_tokens)
    assert got[1].tokens == first + one(spark, "x " * 50, tx.estimate_tokens)
    less = run(got[1].tokens - 1)[1]
    assert less.loaded == [1] and less.skipped == ["token-budget"] and less.tokens == first


def test_prompt_context_reads_digests_and_texts_from_store(spark):
    """The digest of a document and the texts that may load are made once: no part of the plan looks for headings or cuts sections again."""
    plan = plans.prompt_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "#{1,3}" not in plan and "##[" not in plan


def test_words_are_cut_as_spark_cuts_them(spark):
    """Terms and pieces of texts with marks, endings, capitals and letters that one Unicode version has and another lacks."""
    from sievewright.functions import terms

    rng = np.random.default_rng(11)
    letters = terms.alphabet(spark)
    odd = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and letters.odd and re.match(letters.odd, chr(i))][:: 400]
    bits = ["the", "test", "ing", "ed", "s", "ES", " ", "-", "_", "9", "é", "Σ", "İ", "\U00010400", "́", "²", "五", "a", *odd]
    texts = ["".join(rng.choice(bits, size=rng.integers(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pieces = F.regexp_extract_all(F.lower("t"), F.lit(f"({index.WORD}+|{index.MARK}+)"), F.lit(1))
    cutter = terms.Cutter(letters)
    for r in df.select(F.lower("t").alias("low"), tx.tokenize(F.col("t")).alias("terms"), pieces.alias("pieces")).collect():
        assert cutter.terms(r.low) == set(r.terms) and cutter.pieces(r.low) == r.pieces


def test_names_are_cut_from_the_start_of_a_text(spark):
    texts = ["the of and " * 30 + "alpha beta gamma", "alpha", "", "a " * 31 + "xanthous yes no", "one two three four", None, "x" * 63 + " y" * 9 + " beta"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    plain = F.array_join(F.slice(tx.tokenize(F.col("description")), 1, 2), "-")
    assert all(r.name == r.plain for r in catalog.from_documents(docs).select("name", plain.alias("plain")).collect())


def test_only_near_vectors_are_scored_exactly():
    """Under a floor few pairs are scored in 64 bits; the answers are those of scoring all, ties, copies and a vector of no number included."""
    from sievewright.operators.best import Best

    rng = np.random.default_rng(2)
    for top, floor in ((3, 0.3), (5, -1.0)):
        queries, rows = rng.normal(size=(40, 16)), rng.normal(size=(3000, 16))
        rows[5], rows[9] = np.nan, rows[8]
        queries, rows = (m / np.sqrt((m * m).sum(1))[:, None] for m in (queries, rows))
        texts, scored, best = np.arange(3000) // 2, [], Best(40, top, floor)
        score = np.round(queries @ rows.T, 9)
        for i in range(0, 3000, 500):
            exact = lambda q, c: scored.append(len(q)) or score[q, c + i]  # noqa: E731, B023
            best.add((queries @ rows[i : i + 500].T).astype(np.float32), 24 * retrieval.ROUGH, exact, np.arange(i, i + 500), texts[i : i + 500])
        got = list(zip(*(x.tolist() for x in best.rows()), strict=True))
        want = []
        for q in range(40):
            held = {}
            for d in np.lexsort((np.arange(3000), -score[q])).tolist():
                if score[q, d] >= floor and len(held) < top:
                    held.setdefault(int(texts[d]), (q, score[q, d], d, int(texts[d])))
            want += list(held.values())
        assert got == want and sum(scored) < 40 * 3000 // 8


def test_texts_of_no_candidate_are_not_cut(spark):
    """Texts are cut where they are read, only those of candidates, and no text meets the candidates in a shuffle."""
    prompts = spark.createDataFrame([(1, "alpha beta")], "prompt_id long, prompt string")
    cat = spark.createDataFrame([(i, f"alpha w{i}") for i in range(500)], "doc_id long, body string")
    held = spark.createDataFrame([(1, 7, 0.2), (1, 8, 0.2)], "prompt_id long, doc_id long, score double")
    found = retrieval.rerank_blend(held, prompts, cat, 2)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    wanted = index.packed(held.select(F.pmod(F.xxhash64("doc_id"), F.lit(retrieval.CANDIDATES)).alias("h")))
    assert int(index.unpacked(wanted, retrieval.CANDIDATES).sum()) == 2
    assert [(r.doc_id, r.score) for r in found.collect()] == [(7, round(0.17 + 0.075, 9)), (8, round(0.17 + 0.075, 9))]
    with pytest.raises(Exception, match="without a body"):
        retrieval.rerank_blend(spark.createDataFrame([(1, 999, 0.2)], "prompt_id long, doc_id long, score double"), prompts, cat, 2).collect()


def test_places_are_sent_in_few_bytes(spark):
    """Lists of all densities come back as they were; a frequent one costs a byte a place, a rare one four at most."""
    rng = np.random.default_rng(4)
    for trial in range(40):
        lists = [np.sort(rng.choice(70_000, size=int(s), replace=False)).astype(np.int32) for s in rng.choice([0, 1, 2, 40, 300, 20_000, 70_000], size=trial)]
        lists += [np.array([0, 255, 510, 766], np.int32), np.array([254], np.int32), np.array([255], np.int32)] * (trial % 3)
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *lists])
        out, size, near = index._coded(flat, sizes)
        places, number = index._decoded(out, size, near)
        assert np.array_equal(places, flat) and np.array_equal(number, sizes) and all(s <= 4 * n for s, n in zip(size, sizes, strict=True))
        assert all(s < 1.1 * n for s, n in zip(size, sizes, strict=True) if n >= 20_000)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("name"), F.lit("").alias("description"), F.lit(1).alias("activation_tokens"), F.concat(F.lit("alpha beta gamma w"), F.col("id") % 50).alias("body"))
    held = index.build(docs.repartition(4), body=True)
    assert held.table("coded").where("id is not null").agg(F.sum(F.length("coded"))).first()[0] < 1.1 * 12_000
    texts = docs.select("body").distinct().select(F.monotonically_increasing_id().alias("prompt_id"), F.concat("body", F.lit(" never")).alias("prompt"))
    found = index.search(texts, held, 2, 1, [6, 2, 1, 12]).join(texts, "prompt_id").collect()
    assert len(found) == 100 and all(r.matches == r.prompt[: -len(" never")] and r.score == 4 and r.prompt.split()[3] == f"w{r.doc_id % 50}" and r.doc_id < 100 for r in found)


def test_pieces_of_a_shard_make_the_same_lists(spark, monkeypatch):
    """However often a task hands on what it holds, and forgets the terms it met, the lists are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lists = lambda: {(r.shard, r.id, tuple(r.docs)) for r in index.build(catalog.from_documents(docs), body=True).table("postings").collect()}
    want, pieces = lists(), index._pieces
    letters = index.alphabet(spark)

    def small(*a):
        run = pieces(*a)

        def cut(batches):
            import sievewright.operators.index as own

            own.FLUSH, own.KEPT, own.TOLD = 500, 300, 7
            yield from run(x for b in batches for i in range(0, b.num_rows, 11) for x in [b.slice(i, 11)])

        return cut

    monkeypatch.setattr(index, "_pieces", small)
    assert letters.word and lists() == want and len(want) > 1000
