"""Doubling walks and block ranking against plain loops."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, chains, graph, lexical, retrieval
from tessera.operators import scopes as S
from tessera.spec import QuerySpec


@pytest.fixture
def rounds(monkeypatch):
    """How often a walk's reach was written."""
    found = []
    real = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: found.append("origin" in df.columns) or real(df))
    return lambda: sum(found) - 1


def test_a_chain_of_ten_thousand_takes_fifteen_rounds(spark, rounds):
    n = 10_000
    ids = spark.range(n + 1).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("id"), F.when(F.col("id") < n, F.lpad((F.col("id") + 1).cast("string"), 6, "0")).alias("superseded_by"))
    got = graph.history(ids).agg(F.count("*").alias("n"), F.max("step").alias("last"), F.countDistinct("origin").alias("origins"), F.sum(F.col("current").cast("int")).alias("current"), F.count_if(F.col("id").cast("int") == F.col("step")).alias("in_place")).first()
    assert tuple(got) == (n + 1, n, 1, 1, n + 1) and rounds() <= 15


def test_merges_cycles_and_missing_successors(spark):
    rows = [("a", "c"), ("b", "c"), ("c", "d"), ("d", None), ("x", "y"), ("y", "z"), ("z", "y"), ("p", "q"), ("q", "p"), ("m", "gone")]
    got = graph.history(spark.createDataFrame(rows, "id string, superseded_by string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["origin"], []).append((r["step"], r["id"], r["current"]))
    assert {k: sorted(v) for k, v in by.items()} == {"a": [(0, "a", False), (1, "c", False), (2, "d", True)], "b": [(0, "b", False), (1, "c", False), (2, "d", True)], "x": [(0, "x", False), (1, "y", False), (2, "z", False)], "m": [(0, "m", False)]}
    assert graph.history(spark.createDataFrame([], "id string, superseded_by string")).collect() == []


def test_closure_of_a_chain_of_two_thousand_scopes(spark, rounds):
    n = 2000
    scopes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    got = S.closure(scopes).agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.count_if(F.col("descendant").cast("int") - F.col("ancestor").cast("int") == F.col("distance")).alias("right")).first()
    assert tuple(got) == (n * (n + 1) // 2, n - 1, n * (n + 1) // 2) and rounds() <= 12


def table(spark):
    draw, rng = random.Random(2), np.random.default_rng(2)
    rows = []
    for k in range(700):
        vec = [float(x) for x in rng.normal(size=8).round(1)]
        vec = [0.5] * 8 if k % 3 == 0 else vec  # a large group of equal vectors
        vec = {1: None, 2: vec[:5], 3: [], 4: [None, *vec[1:]]}.get(k % 50, vec)
        rows.append((f"a{k:04d}", "big" if k % 3 == 0 else draw.choice(["s1", "s2", "s3", None]), draw.choice([True, False, None]), vec, draw.random()))
    return rows, spark.createDataFrame(rows, "id string, scope string, published boolean, vec array<float>, bonus double").repartition(5)


def dot(a, b):
    out = sum(float(np.float32(x)) * y for x, y in zip(a, b, strict=True)) if len(a) == len(b) and None not in a and None not in b else 0.0
    return round(out, 9)


@pytest.mark.parametrize(("k", "weight", "least", "round_bytes"), [(5, 1.0, None, 1 << 25), (3, 0.7, 0.2, 1 << 25), (400, 1.0, None, 1 << 25), (5, 0.9, None, 300)])
def test_blocks_equal_a_plain_ranking(spark, monkeypatch, k, weight, least, round_bytes):
    monkeypatch.setattr(blocks, "ROUND_BYTES", round_bytes)  # the last case takes several rounds
    rows, artifacts = table(spark)
    rng = np.random.default_rng(7)
    asked = [(f"q{i}", [float(x) for x in rng.normal(size=8).round(2)]) for i in range(9)] + [("short", [1.0, 2.0]), ("none", None), ("unseen", [1.0] * 8)]
    sees = [(q, s, i % 2 == j % 2) for i, (q, _) in enumerate(asked[:-1]) for j, s in enumerate(["big", "s1", "s3"]) if (i + j) % 4]
    queries = spark.createDataFrame(asked, "query_id string, qvec array<double>")
    got = blocks.topk(queries, spark.createDataFrame(sees, "query_id string, scope string, any_state boolean"), artifacts, k, weight, least).collect()
    want = []
    for q, qvec in asked:
        found = []
        for id, scope, published, vec, bonus in rows:
            state = [a for x, s, a in sees if x == q and s == scope]
            if qvec is None or vec is None or not state or not (state[0] or published):
                continue
            score = dot(vec, qvec)
            if least is None or score >= least:
                found.append((-round(weight * score + bonus, 9), id, score))
        want += [(q, rank + 1, id, score) for rank, (_, id, score) in enumerate(sorted(found)[:k])]
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9) + 0.0) for r in got) == sorted(want)


def test_a_task_passes_on_k_artifacts_of_a_query(spark, monkeypatch):
    monkeypatch.setattr(blocks, "GATHERED", 500)  # so that a task gathers many times
    rng = np.random.default_rng(5)
    batches, size = [], 300
    for b in range(20):
        ids, vec = [f"a{b * size + j:05d}" for j in range(size)], rng.normal(size=(size, 4))
        batches.append(pa.record_batch([pa.array([("s", "t")[j % 2] for j in range(size)]), pa.array(ids), pa.array([True] * size), pa.array(vec.tolist(), pa.list_(pa.float64())), pa.array(np.zeros(size))], names=["scope", "id", "published", "vec", "bonus"]))
    asked = rng.normal(size=(30, 4))
    vectors = spark.sparkContext.broadcast((asked, np.full(30, 4), {x: (np.arange(30), np.arange(0)) for x in "st"}))
    found = pa.Table.from_batches(blocks._best(vectors, 3, 1.0, -np.inf)(iter(batches))).to_pylist()
    assert len(found) == 3 * 30
    every = np.concatenate([np.array(b.column("vec").to_pylist()) for b in batches])
    for q in range(30):
        assert sorted(r["id"] for r in found if r["query"] == q) == sorted(f"a{j:05d}" for j in np.argsort(-(every @ asked[q]))[:3])


def test_a_task_passes_on_k_documents_of_a_query_by_words(monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", 40)
    words = pa.list_(pa.struct([("term", pa.string()), ("f", pa.int64())]))
    rows = [{"scope": "s", "id": f"a{j:03d}", "published": j % 2 == 0, "dl": 4 + j % 3, "words": [{"term": t, "f": 1 + j % 2} for t in ("one", "two")[: 1 + j % 2]]} for j in range(300)]
    batch = pa.Table.from_pylist(rows, pa.schema([("scope", pa.string()), ("id", pa.string()), ("published", pa.bool_()), ("dl", pa.int32()), ("words", words)])).to_batches()[0]
    asked = SimpleNamespace(value=({"one": (np.array([0, 1]), np.array([0.5, 0.5])), "two": (np.array([1]), np.array([2.0]))}, np.array([5.0, 5.0]), {"s": (np.array([0, 1]), np.zeros(0, np.int64))}))
    found = pa.Table.from_batches(lexical._best(asked, 4)(iter([batch]))).to_pylist()
    assert len(found) == 2 * 4
    assert {q: [r["id"] for r in found if r["query"] == q] for q in (0, 1)} == {q: ["a003", "a009", "a015", "a021"] for q in (0, 1)}  # equal documents by id


def test_candidates_of_one_scope_are_spread_over_tasks(spark):
    scopes = spark.createDataFrame([("root", None, False), ("s", "root", False)], "id string, parent string, archived boolean").withColumn("title", F.col("id"))
    artifacts = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("scope"), F.lit("insight").alias("kind"), F.lit("worktree").alias("tier"), (F.col("id") % 2 == 0).alias("published"))
    queries = spark.createDataFrame([(f"q{k}", x) for k, x in enumerate(["root", "s", "s"])], "query_id string, scope string")
    found = S.candidates(queries, scopes, artifacts, S.closure(scopes), QuerySpec("collapsed"))
    assert found.count() == found.distinct().count() == 6000
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 6000 / 2


@pytest.mark.parametrize("weight", [1.0, 0.0])
def test_counted_ranks_are_places_in_the_whole_order(spark, weight):
    """Without a weight the bonus alone orders, with very many equal keys."""
    rows, artifacts = table(spark)
    artifacts = artifacts.withColumn("bonus", F.floor(F.col("bonus") * 3).cast("double") if weight == 0 else F.lit(0.0))
    queries = spark.createDataFrame([("q0", [1.0] * 8), ("q1", [0.3] * 7 + [-2.0])], "query_id string, qvec array<double>")
    reached = spark.createDataFrame([("q0", "big", True), ("q0", "s1", False), ("q1", "big", False)], "query_id string, scope string, any_state boolean")
    whole = blocks.topk(queries, reached, artifacts, 10_000, weight)
    want = {(r["query_id"], r["id"]): r["rank"] for r in whole.collect()}
    wanted = whole.filter("rank % 7 = 1").select("query_id", "id")
    got = {(r["query_id"], r["id"]): r["rank"] for r in blocks.ranks(queries, reached, artifacts, wanted, weight).collect()}
    assert len(got) > 30 and got == {x: want[x] for x in got}


def test_blocks_of_empty_tables(spark):
    _, artifacts = table(spark)
    queries = spark.createDataFrame([("q", [1.0] * 8)], "query_id string, qvec array<double>")
    reached = spark.createDataFrame([("q", "s1", True)], "query_id string, scope string, any_state boolean")
    assert blocks.topk(queries.limit(0), reached, artifacts, 3).collect() == []
    assert blocks.topk(queries, reached.limit(0), artifacts, 3).collect() == []
    assert blocks.topk(queries, reached, artifacts.limit(0), 3).collect() == []


def test_graph_boost_by_blocks_equals_all_candidates(spark):
    rows, artifacts = table(spark)
    artifacts = artifacts.filter("vec IS NOT NULL AND scope IS NOT NULL").withColumns({"kind": F.lit("insight"), "tier": F.lit("worktree"), "summary": F.col("id"), "content": F.lit(""), "superseded_by": F.lit(None).cast("string")})
    scopes = spark.createDataFrame([("root", None, False), *((s, "root", False) for s in ("big", "s1", "s2", "s3"))], "id string, parent string, archived boolean").withColumn("title", F.col("id"))
    rng = np.random.default_rng(11)
    queries = spark.createDataFrame([(f"q{i}", v, [float(x) for x in rng.normal(size=8)]) for i, v in enumerate(["root", "s1", "s2"])], "query_id string, scope string, qvec array<double>")
    draw = random.Random(4)
    edges = spark.createDataFrame([(draw.choice(rows)[0], draw.choice(rows)[0], "k") for _ in range(900)], "from_id string, to_id string, kind string")
    spec = QuerySpec("collapsed", graph_boost=0.6, top_k=12)
    hits = retrieval.retrieve(queries, scopes, artifacts, spec, edges=edges, with_paths=False)
    found = S.current(S.candidates(queries, scopes, artifacts, S.closure(scopes), spec), spec)
    all_ = retrieval.graph_boost(retrieval.cosine(found, queries).withColumn("sort_key", F.col("score")), edges, 0.6, "sort_key")
    want = retrieval.ranked(all_, "sort_key").filter("rank <= 12")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(hits) == key(want)


@pytest.mark.parametrize("more", [{}, {"min_score": 0.4}, {"graph_boost": 0.5}])
def test_hybrid_by_contenders_equals_ranks_of_all_candidates(spark, more):
    rows, artifacts = table(spark)
    draw = random.Random(8)
    texts = {r[0]: " ".join(draw.choice(["red", "blue", "green", "one", "two", "x"]) for _ in range(draw.randint(0, 6))) for r in rows}
    texts = spark.createDataFrame(list(texts.items()), "id string, summary string")
    artifacts = artifacts.filter("scope IS NOT NULL").join(texts, "id").withColumns({"kind": F.lit("insight"), "tier": F.lit("worktree"), "content": F.lit(""), "superseded_by": F.lit(None).cast("string")})
    scopes = spark.createDataFrame([("root", None, False), *((s, "root", False) for s in ("big", "s1", "s2", "s3"))], "id string, parent string, archived boolean").withColumn("title", F.col("id"))
    rng = np.random.default_rng(12)
    asked = [("q0", "root", "red red two"), ("q1", "s1", "green"), ("q2", "big", "nowhere"), ("q3", "s2", "")]
    queries = spark.createDataFrame([(*q, [float(x) for x in rng.normal(size=8)]) for q in asked], "query_id string, scope string, text string, qvec array<double>")
    edges = spark.createDataFrame([(draw.choice(rows)[0], draw.choice(rows)[0], "k") for _ in range(900)], "from_id string, to_id string, kind string")
    spec = QuerySpec("collapsed", "hybrid", top_k=7, **more)
    hits = retrieval.retrieve(queries, scopes, artifacts, spec, edges=edges, with_paths=False)
    found = S.current(S.candidates(queries, scopes, artifacts, S.closure(scopes), spec), spec)
    scored = retrieval.cosine(found, queries)
    scored = scored.join(retrieval.bm25(scored.select("id", F.col("summary").alias("text")).distinct(), queries, scored), ["query_id", "id"])
    # Equal vectors must have equal scores, in whatever order they are summed.
    scored = retrieval.rrf(scored.withColumn("score", F.round("score", 9)), "score", "bm25").withColumn("sort_key", F.col("fused"))
    if more.get("graph_boost"):
        scored = retrieval.graph_boost(scored, edges, 0.5, "sort_key")
    want = retrieval.ranked(scored.filter(F.col("score") >= more.get("min_score", -1e9)), "sort_key").filter("rank <= 7")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(hits) == key(want)


def test_a_store_builds_its_index_once(spark):
    from tessera.functions.text import bag_of_words_embedder
    from tessera.store import MemoryStore

    store = MemoryStore.empty(spark, embed=bag_of_words_embedder())
    root, store = store.create_scope(None, "worktree", "project")
    first, store = store.push(root, "the cache is redis")
    _, store = store.push(root, "the queue is slow")
    asked = spark.createDataFrame([("q", root, "which cache")], "query_id string, scope string, text string")
    spec = QuerySpec("collapsed", "hybrid", top_k=1)
    assert [r["id"] for r in store.query(asked, spec).collect()] == [first]
    index = store.index()
    assert store.query(asked, spec).first()["id"] == first and store.index() is index
    _, later = store.push(root, "which cache is it")
    assert later.query(asked, spec).first()["summary"] == "which cache is it" and later.index() is not index


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_related_in_the_order_of_a_search(spark, direction):
    draw = random.Random(6)
    ids = [f"n{k:02d}" for k in range(40)]
    edges = sorted({(draw.choice(ids), draw.choice(ids), draw.choice("jk")) for _ in range(110)})
    superseded = {i for i in ids if draw.random() < 0.2}

    def search(start, depth):
        visited, frontier, order = {start}, [start], []
        for d in range(1, depth + 1):
            following = []
            for at in frontier:
                for nb in [b for a, b, _ in edges if a == at and direction != "in"] + [a for a, b, _ in edges if b == at and direction != "out"]:
                    if nb not in visited:
                        visited.add(nb), order.append((nb, d)), following.append(nb)
            frontier = following
        return [(x, d) for x, d in order if x not in superseded]

    artifacts = spark.createDataFrame([(i, "z" if i in superseded else None) for i in ids], "id string, superseded_by string")
    starts = spark.createDataFrame([(i,) for i in ids[:6]], "start string")
    got = graph.related(starts, spark.createDataFrame(edges, "from_id string, to_id string, kind string"), artifacts, direction, (), 3).orderBy("start", "place").collect()
    for start in ids[:6]:
        mine = [r for r in got if r["start"] == start]
        assert [(r["id"], r["distance"]) for r in mine] == search(start, 3) and [r["place"] for r in mine] == list(range(1, len(mine) + 1))


def test_equal_documents_stand_by_id_in_words(spark):
    """What a task counts of documents with the same words, whose sums must not follow the order of their terms."""
    rng = np.random.default_rng(21)
    words = [f"w{j}" for j in range(24)]
    artifacts = [(f"a{j:04d}", "s", True, "insight", "worktree", "", " ".join(rng.permutation(words[: 12 + 4 * (j % 3)])), None, [1.0]) for j in range(240)]
    artifacts += [(f"b{j:04d}", "s", True, "insight", "worktree", "", " ".join(rng.choice(words, 3)), None, [1.0]) for j in range(400)]
    artifacts = spark.createDataFrame(artifacts, "id string, scope string, published boolean, kind string, tier string, content string, summary string, superseded_by string, vec array<double>")
    queries = spark.createDataFrame([("q", " ".join(words)), ("none", "nowhere")], "query_id string, text string")
    reached = spark.createDataFrame([("q", "s", True), ("none", "s", True)], "query_id string, scope string, any_state boolean")
    index = lexical.build(artifacts)
    asked = lexical.ask(index.postings, index.docs, queries, reached)
    best = [r["id"] for r in lexical.best(asked, 640).filter("query_id = 'q'").orderBy("rank").collect()]
    assert len(best) == 640
    for k in range(3):
        assert [x for x in best if x < "b" and int(x[1:]) % 3 == k] == [f"a{j:04d}" for j in range(k, 240, 3)]
    ids = sorted(r["id"] for r in artifacts.select("id").collect())
    wanted = spark.createDataFrame([(q, x, k + 1) for q in ("q", "none") for k, x in enumerate(ids) if k % 5 == 0], "query_id string, id string, id_rank long")
    got = {(r["query_id"], r["id"]): r["rank"] for r in lexical.ranks(asked, wanted, 200).collect()}
    assert {x: k for (q, x), k in got.items() if q == "q"} == {x: best.index(x) + 1 for x in ids[::5]}
    assert {x: k for (q, x), k in got.items() if q == "none"} == {x: ids.index(x) + 1 for x in ids[::5]}


def test_a_task_counts_without_a_row_for_a_pair_by_words(monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", 70)
    words = pa.list_(pa.struct([("term", pa.string()), ("f", pa.int64())]))
    rows = [{"scope": "st"[j % 2], "id": f"a{j:03d}", "published": True, "dl": 4, "words": [{"term": t, "f": 1} for t in ("one", "two", "x")[: 1 + j % 3]]} for j in range(300)]
    batch = pa.Table.from_pylist(rows, pa.schema([("scope", pa.string()), ("id", pa.string()), ("published", pa.bool_()), ("dl", pa.int32()), ("words", words)])).to_batches()[0]
    sees = (np.array([0]), np.zeros(0, np.int64))
    asked = SimpleNamespace(value=({"two": (np.array([0]), np.array([2.0]))}, np.array([4.0]), {"s": sees, "t": sees}))
    key = 2.0 * 1 * 2.2 / (1 + 1.2)
    wanted = SimpleNamespace(value=(np.array(["a004", "a299"]), {0: (np.array([0, 1]), np.array([key]), np.array([0, 0]))}))
    found = pa.Table.from_batches(lexical._before(asked, wanted)(iter([batch]))).to_pylist()
    assert [(r["id"], r["before"], r["ids_before"], r["total"]) for r in found] == [("a004", 2, 2, 200), ("a299", 199, 199, 200)]


def test_a_scope_without_a_term_of_the_round():
    words = pa.list_(pa.struct([("term", pa.string()), ("f", pa.int64())]))
    rows = [{"scope": s, "id": s + "1", "published": True, "dl": 1, "words": [{"term": t, "f": 1}]} for s, t in (("r", "x"), ("s", "one"), ("t", "x"))]
    batch = pa.Table.from_pylist(rows, pa.schema([("scope", pa.string()), ("id", pa.string()), ("published", pa.bool_()), ("dl", pa.int32()), ("words", words)])).to_batches()[0]
    sees = (np.array([0]), np.zeros(0, np.int64))
    asked = SimpleNamespace(value=({"one": (np.array([0]), np.array([2.0]))}, np.array([1.0]), {x: sees for x in "rst"}))
    assert [r["id"] for r in pa.Table.from_batches(lexical._best(asked, 4)(iter([batch]))).to_pylist()] == ["s1"]
