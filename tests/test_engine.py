"""Behaviour of single operators on small inputs."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import evaluation, graph, retrieval
from tessera.operators import scopes as S
from tessera.sources import ingest
from tessera.spec import Floors, QuerySpec, parse_kinds, preset
from tessera.store import MemoryStore


def test_cosine_order_and_ties(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<float>")
    found = spark.createDataFrame([("q", "a", [1.0, 0.0]), ("q", "b", [0.0, 1.0]), ("q", "c", [0.6, 0.8]), ("q", "d", [1.0, 0.0]), ("q", "e", [1.0]), ("q", "f", None)], "query_id string, id string, vec array<float>")
    rows = retrieval.ranked(retrieval.cosine(found, queries)).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "d", "c", "b", "e"] and rows[-1]["score"] == 0


def test_fusion_by_ranks(spark):
    rows = spark.createDataFrame([("q", "a", 2.0, 1.0), ("q", "b", 1.0, 2.0), ("q", "c", 0.0, 0.0)], "query_id string, id string, x double, y double")
    got = {r["id"]: r["fused"] for r in retrieval.rrf(rows, "x", "y").collect()}
    assert got["a"] == got["b"] == pytest.approx(1 / 61 + 1 / 62) and got["c"] == pytest.approx(2 / 63)


def test_rarer_term_scores_higher(spark):
    texts = spark.createDataFrame([("q", "1", "common rare"), ("q", "2", "common filler"), ("q", "3", "common filler"), ("q", "4", "")], "query_id string, id string, text string")
    queries = spark.createDataFrame([("q", "rare common")], "query_id string, text string")
    got = {r["id"]: r["bm25"] for r in retrieval.bm25(texts, queries).collect()}
    assert got["1"] > got["2"] == got["3"] > got["4"] == 0


@pytest.mark.parametrize(("scores", "want"), [([0.5], "floor_miss"), ([0.80, 0.78], "margin_ambiguous"), ([0.82, 0.70], "ok"), ([], "empty")])
def test_verdicts(spark, scores, want):
    queries = spark.createDataFrame([("q",)], "query_id string")
    hits = spark.createDataFrame([("q", k + 1, s, None) for k, s in enumerate(scores)], "query_id string, rank int, score double, rerank_score double")
    assert retrieval.decide(hits, queries, Floors.of_model("BAAI/bge-small-en-v1.5")).first()["confidence"] == want


def test_conformal_floor(spark):
    tops = spark.createDataFrame([(x / 10,) for x in range(5, 11)], "top_score double")
    assert evaluation.conformal_floor(tops, 0.9).first()["floor"] == pytest.approx(0.55)


def test_closure_stops_at_cycles(spark):
    scopes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "missing"), ("d", None)], "id string, parent string")
    assert {tuple(r) for r in S.closure(scopes).filter("distance > 0").collect()} == {("b", "a", 1), ("a", "b", 1)}


def test_related_passes_superseded(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "a", "k")], "from_id string, to_id string, kind string")
    artifacts = spark.createDataFrame([("a", None), ("b", "c"), ("c", None)], "id string, superseded_by string")
    got = graph.related(spark.createDataFrame([("a",)], "start string"), edges, artifacts, "out", (), 5).collect()
    assert [(r["id"], r["distance"]) for r in got] == [("c", 2)]


def test_chunks_cover_lines_and_attach_comments():
    text = "package x\n\n// Doc.\nfunc A() {\n}\n\nfunc B() {\n}"
    got = ingest.semantic_chunks(text, "go", 25, 0)
    assert [(a, b) for _, a, b in got] == [(1, 2), (3, 6), (7, 8)]
    lines = [f"line {k} of the text here" for k in range(50)]
    pieces = ingest.window_chunks(lines, 200, 50)
    assert {k for _, a, b in pieces for k in range(a, b + 1)} == set(range(1, 51)) and all(len(t) <= 200 for t, _, _ in pieces)
    assert ingest.window_chunks(["x" * 5000], 200, 50) == [("x" * 5000, 1, 1)] and ingest.window_chunks(["", " "], 200, 50) == []


def test_embedding_is_a_unit_bag_of_words():
    a, b, c = X.bag_of_words_vectors(pd.Series([["one", "two"], ["two", "one"], []]), pd.Series(["", "", "?"]), 8)
    assert (a == b).all() and float(a @ a) == pytest.approx(1) and sorted(c.tolist())[-1] == 1


def test_presets():
    assert preset("hierarchical").mode == "hybrid" and preset("nothing") == QuerySpec() and parse_kinds("file, seed, x") == ("document", "seed")


def test_store_loop(spark, tmp_path):
    store = MemoryStore.empty(spark, embed=X.bag_of_words_embedder(64))
    root, store = store.create_scope(None, "worktree", "root")
    child, store = store.create_scope(root, "session", "child")
    old, store = store.push(child, "redis is the cache", published=True, meta={"trust": "forged"})
    new, store = store.push(child, "memcached is the cache", supersedes=[old], relations=[(old, "refines")])
    with pytest.raises(LookupError):
        store.push(child, "x", supersedes=["missing"])
    with pytest.raises(ValueError):
        store.supersede(new, new)
    asked = spark.createDataFrame([("q", root, "cache")], "query_id string, scope string, text string")
    assert [r["id"] for r in store.query(asked, preset("collapsed")).collect()] == [new]
    assert store.query(asked, QuerySpec()).isEmpty()
    copy, store = store.fork(child, "copy")
    assert store.artifacts.filter(F.col("scope") == copy).count() == 1
    _, store = store.cross_version(child, "one\n\n two ", "three")
    assert store.artifacts.filter("kind = 'seed'").count() == 3
    store.save(str(tmp_path / "s"))
    again = MemoryStore.load(spark, str(tmp_path / "s")).delete_artifact(old)
    assert again.edges.isEmpty() and again.artifacts.filter(F.col("id") == new).first()["derived_from"] == [old]


def test_windows_by_their_definition():
    from tessera.sources.ingest import semantic_chunks, window_chunks

    assert window_chunks(["", "", "abc", "def"], 100, 0) == [("abc\ndef", 1, 4)]
    assert window_chunks(["", " ", ""], 100, 0) == [] == window_chunks([""], 10, 3)

    def slow(lines, most, overlap):
        out, at = [], 0
        while at < len(lines):
            text, to = "", at
            while to < len(lines) and not (text and len((text + "\n" + lines[to]).encode()) > most):
                text, to = (text + "\n" if text else "") + lines[to], to + 1
            if text.strip():
                out.append((text.rstrip("\n"), at + 1, to))
            if to == len(lines):
                break
            back = to
            while overlap and back > at + 1 and len("\n".join(lines[back - 1 : to]).encode()) + 1 < overlap:
                back -= 1
            at = back
        return out

    rng = random.Random(3)
    for _ in range(400):
        lines = ["x" * rng.choice([0, 0, 1, 3, 8, 15]) + rng.choice(["", "é"]) * rng.randint(0, 1) for _ in range(rng.randint(1, 14))]
        most = rng.randint(2, 30)
        overlap = rng.randint(0, most - 1)
        assert window_chunks(lines, most, overlap) == slow(lines, most, overlap)
        for language in ("generic", "markdown"):
            got = semantic_chunks("\n".join(lines), language, most, 0)
            assert all(len(t.encode()) <= most or "\n" not in t for t, _, _ in got)
            assert {k for _, a, b in got for k in range(a, b + 1)} >= {k + 1 for k, x in enumerate(lines) if x}


def test_seeds_and_lines_are_trimmed_of_any_white_space(spark):
    from tessera.functions.text import content_lines

    row = spark.createDataFrame([("\tkeep a\r\n  \t\nkeep b\r\n　 \nc ",)], "t string")
    assert row.select(content_lines(F.col("t")).alias("x")).first()["x"] == ["keep a", "keep b", "c"]
    store = MemoryStore.empty(spark)
    scope, store = store.create_scope(None, "session", "s")
    new, store = store.cross_version(scope, "\tfirst\r\n \t\n", "second\r")
    rows = store.artifacts.filter(F.col("scope") == new).orderBy("id").collect()
    assert [r["summary"] for r in rows] == ["first", "second"] and store.get_scope(new)["seed_from"] == rows[0]["id"]
    assert store.get_scope(new)["forked_from"] == scope


def test_chunks_are_passed_on_in_small_batches(spark, monkeypatch):
    from tessera.sources import ingest

    monkeypatch.setattr(ingest, "HELD_CHARS", 1000)
    handed = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: handed.append(run) or self)
    files = spark.createDataFrame([("a", "x", "markdown")], "path string, text string, language string")
    ingest.chunk(files, 300, 0, semantic=False)
    batch = pa.record_batch([pa.array([f"f{k}" for k in range(50)]), pa.array(["line of text\n" * 30] * 49 + [None]), pa.array(["markdown"] * 50)], names=["path", "text", "language"])
    sizes = [b.num_rows for b in handed[0](iter([batch]))]
    assert len(sizes) >= 15 and max(sizes) <= 9


def test_nearest_against_brute_force(spark):
    from tessera.operators.nearest import nearest

    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(90, 6)), 1)
    vectors[20:30] = vectors[3]
    rows = [(f"{k:03d}", v.tolist()) for k, v in enumerate(vectors)] + [("zzz", None), ("zz", [1.0])]
    df = spark.createDataFrame(rows, "id string, vec array<float>")
    got = {}
    for r in nearest(df.filter("id < '040'").withColumn("query_id", F.col("id")), df, 3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for q in range(40):
        v = vectors.astype(np.float32).astype(float)
        score = v @ v[q]
        want = sorted((k for k in range(90) if k != q), key=lambda k: (-score[k], k))[:3]
        assert [int(got[f"{q:03d}"][k]) for k in (1, 2, 3)] == want
    assert nearest(df.limit(0).withColumn("query_id", F.col("id")), df, 3).isEmpty()


def test_store_traces_guards_and_floors(spark, tmp_path):
    store = MemoryStore.empty(spark, embed=X.bag_of_words_embedder(16))
    scope, store = store.create_scope(None, "session", "s")
    _, store = store.push(scope, "the cache is redis", trust="ingested")
    other, store = store.push(scope, "short", embed_text="which queue is used", kind="document")
    asked = spark.createDataFrame([("q1", scope, "which queue is used")], "query_id string, scope string, text string")
    hits, traced = store.query_traced(asked, QuerySpec(top_k=1))
    assert [r["id"] for r in hits.collect()] == [other]
    row, seen = traced.trace("q1")
    assert row["text"] == "which queue is used" and sorted((r["rank"] or 0) for r in seen.collect()) == [0, 1]
    assert [r["query_id"] for r in traced.recent_traces(1).collect()] == ["q1"]
    with pytest.raises(LookupError):
        traced.trace("q2")
    with pytest.raises(ValueError, match="numbers"):
        store.query(asked.withColumn("qvec", F.array(F.lit(1.0))), QuerySpec()).collect()
    tuned = store.calibrate("m", spark.createDataFrame([(0.2,), (0.4,)], "top_score double")).set_config("conf.margin.m", "no number")
    response = tuned.respond(asked, QuerySpec(), "m").first()
    assert response["confidence"] == "ok" and response["untrusted"] and response["hits"][0]["id"] == other
    assert '"confidence":"ok"' in retrieval.as_json(tuned.respond(asked, QuerySpec(), "m")).first()["json"]
    reranked = spark.createDataFrame([(0.1, 0.6), (0.2, 0.8)], "top_score double, rerank_score double")
    assert float(store.calibrate("m", reranked, 0.5, reranked=True).get_config("conf.rerank.m")) == pytest.approx(0.7)
    for bad in (reranked.limit(0), reranked.withColumn("rerank_score", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            store.calibrate("m", bad, reranked=True)
    locked = store.lock(b"k" * 32)
    locked.unlock(b"k" * 32), store.unlock(None)
    for s, key in ((locked, b"x" * 32), (locked, None), (store, b"k" * 32)):
        with pytest.raises(ValueError):
            s.unlock(key)
    again = MemoryStore.load(spark, str(tmp_path)) if traced.save(str(tmp_path)) else None
    assert again.trace("q1")[1].count() == 2 and again.get_config("emb_model") == "mock-bow:16"
    with pytest.raises(ValueError, match="mock-bow"):
        MemoryStore.load(spark, str(tmp_path), embed=X.bag_of_words_embedder(8))


def test_paths_stay_inside(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "out").symlink_to(tmp_path)
    assert ingest.contained(str(tmp_path / "a"), "b/c").endswith("/a/b/c")
    for bad in ("..", "out/x", "/etc"):
        with pytest.raises(ValueError):
            ingest.contained(str(tmp_path / "a"), bad)


def test_written_in_part_is_written_again(spark):
    wanted = spark.createDataFrame([(p, "s", 2) for p in "abcde"] + [("g", "s", 0)], "path string, sig string, n int")
    rows = [("a", 0, "s"), ("a", 1, "s"), ("b", 0, "s"), ("c", 0, "s"), ("c", 1, "old"), ("d", 0, "s"), ("d", 0, "s"), ("f", 0, "s")]
    got = ingest.completeness(wanted, spark.createDataFrame(rows, "path string, chunk int, sig string"))
    assert {r["path"]: r["action"] for r in got.collect()} == {"a": "unchanged", "b": "update", "c": "update", "d": "update", "e": "add", "f": "remove", "g": "unchanged"}


def test_turns_and_wall_by_their_rules(spark):
    hits = spark.createDataFrame([("a", 1, "x", "Redis cache", "uses REDIS"), ("a", 2, "y", "queue", "holds kafka topics"), ("b", 1, "y", "queue", None)], "query_id string, rank int, id string, summary string, content string")
    schema = "query_id string, expect struct<target:string,mentions:array<string>,forbid:array<string>,max_drills:int,baseline:array<string>>"
    artifacts = spark.createDataFrame([("x", "Redis cache", "uses REDIS"), ("y", "queue", None)], "id string, summary string, content string")

    def turn(query, expect):
        return evaluation.turn_metrics(spark.createDataFrame([(query, expect)], schema), hits, artifacts).first()

    at_once = turn("a", ("x", ["redis"], ["mongo"], 0, ["x", "y", "y"]))
    assert at_once["met"] and at_once["sufficient"] and at_once["expected_rank"] == 1 and at_once["baseline_tokens"] == 4 and at_once["overview_tokens"] == 3
    drilled = turn("a", (None, ["Kafka"], None, 3, None))
    assert drilled["met"] and not drilled["sufficient"] and drilled["drills"] == 2 and drilled["raw_tokens"] == 5 and not drilled["expected_found"]
    too_few = turn("a", (None, ["kafka"], None, 1, None))
    assert not too_few["met"] and too_few["drills"] == 1
    forbidden = turn("a", ("x", None, ["CACHE"], 9, None))
    assert not forbidden["met"] and not forbidden["forbid_ok"] and forbidden["forbids"] and forbidden["drills"] == 2
    nothing = turn("none", None)
    assert nothing["met"] and not nothing["sufficient"] and nothing["overview_tokens"] == 0
    empty = evaluation.scenario_report(evaluation.turn_metrics(spark.createDataFrame([], schema), hits, artifacts)).first()
    assert empty["turns"] == 0 and empty["constraint_survival"] == "n/a" and empty["recall"] == 0.0 and not empty["passed"]
    gold = spark.createDataFrame([("a", ["y", "z"], "y", "x"), ("b", ["x"], "y", "x"), ("c", None, None, None)], "query_id string, refs array<string>, current string, stale string")
    rows = {r["query_id"]: r for r in evaluation.wall_gold(gold, hits).collect()}
    assert rows["a"]["ref_ranks"] == [2, 0] and rows["a"]["gold_found"] and rows["a"]["currency_ok"] is False
    assert not rows["b"]["gold_found"] and rows["b"]["currency_ok"] is True and rows["c"]["currency_ok"] is None
    assert evaluation.wall_summary(evaluation.wall_gold(gold, hits)).first()[:] == (3, 1 / 3, 2, 1)


def test_ingest_brings_the_store_to_the_files(spark):
    store = MemoryStore.empty(spark)
    root, store = store.create_scope(None, "worktree", "home")

    def run(store, files):
        return store.ingest(root, spark.createDataFrame(files, "path string, text string"), max_chars=10, overlap=0)

    first = [("a.md", "one\n\ntwo three four\n"), ("x/y/b.py", "def f():\n  pass"), ("x/c.md", None), ("x/c.md", None), ("z/d.md", "here")]
    stats, store = run(store, first)
    assert (stats["files_added"], stats["files_unchanged"], stats["scopes_created"], stats["scopes_removed"]) == (3, 1, 3, 0)
    titles = {r["title"]: r["rollup_summary"] for r in store.scopes.collect()}
    assert titles == {"home": "directory home; files: a.md", "x": None, "y": "directory x/y; files: b.py", "z": "directory z; files: d.md"}
    ids = {r["id"] for r in store.artifacts.collect()}
    again, store = run(store, first)
    assert again == {**dict.fromkeys(again, 0), "files_unchanged": 4} and {r["id"] for r in store.artifacts.collect()} == ids
    # A chunk is lost, a file is gone, and with it two scopes.
    lost = store.artifacts.filter("meta['path'] = 'a.md' AND meta['chunk'] = '0'").first()["id"]
    stats, store = run(store.delete_artifact(lost), [f for f in first if f[0] != "x/y/b.py"])
    assert (stats["files_updated"], stats["files_removed"], stats["scopes_removed"]) == (1, 1, 2)
    assert {r["meta"]["path"] for r in store.artifacts.collect()} == {"a.md", "z/d.md"} and all(r["meta"]["trust"] == "ingested" for r in store.artifacts.collect())
    stats, store = run(store, [])
    assert stats["files_removed"] == 2 and store.scopes.count() == 1 and store.artifacts.isEmpty()
