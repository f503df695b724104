"""The write log: versions, merging, compaction, contents by hash and sealed."""

import base64
import glob
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import bag_of_words_embedder
from tessera.log import StoreLog, fold
from tessera.sources.blobs import read_key
from tessera.spec import Detail, QuerySpec, preset
from tessera.store import new_id


def scopes(spark):
    return spark.createDataFrame([("s", None, "worktree", "s"), ("t", "s", "session", "t")], "id string, parent string, role string, title string")


def requests(spark, rows):
    return spark.createDataFrame(rows, "id string, scope string, summary string, content string, supersedes array<string>")


def test_fold_is_a_replay(spark):
    rng = random.Random(5)
    ops = [(k, *(rng.choice([None, "x", "y", "z"]) for _ in range(2)), rng.choice(["put", "patch", "patch", "delete"]), v) for v in range(60) for k in rng.sample("abcdefgh", 3)]
    ops = [(k, None, None, op, v) if op == "delete" else (k, a, None if op == "patch" else b, op, v) for k, a, b, op, v in ops]
    want = {}
    for k, a, b, op, _ in ops:
        if op == "patch" and want.get(k):
            want[k] = (a or want[k][0], want[k][1])
        elif op != "patch":
            want[k] = (a, b) if op == "put" else None
    schema = "k string, a string, b string, _op string, _version long"
    # Folding a beginning first gives the same as folding all at once.
    for at in (0, 1, 17, 40, 60):
        first = fold(spark.createDataFrame([r for r in ops if r[4] < at], schema), ["k"], ["a"])
        got = fold(first.union(spark.createDataFrame([r for r in ops if r[4] >= at], schema)), ["k"], ["a"]).filter("_op = 'put'").collect()
        assert {r["k"]: (r["a"], r["b"]) for r in got} == {k: v for k, v in want.items() if v}


def test_versions_merges_and_plans(spark, tmp_path):
    log = StoreLog.create(spark, str(tmp_path / "log"), merge_every=6)
    log.create_scopes(scopes(spark))
    first = log.push(requests(spark, [(f"a{k}", "s", f"note {k}", "same" if k % 2 else f"text {k}", None) for k in range(40)]))
    log.compact()
    sizes, lives = [], {}
    for k in range(9):
        log.push(requests(spark, [(f"b{k}", "t", f"late {k}", None, [f"a{k}"])]))
        if k == 3:
            log.publish(spark.createDataFrame([("b0",), ("a5",), ("a5",)], "id string"))
            log.relate(spark.createDataFrame([("a1", "b1", "refines"), ("a1", "a2", "refines")], "from_id string, to_id string, kind string"))
        if k == 4:
            log.delete(spark.createDataFrame([("a1",)], "id string"))
        plan = log.table("artifacts")._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("\n"))
        lives[log.version] = 41 + k - (k >= 4)
    # A snapshot alone, or a snapshot and its segments, however many.
    assert len(set(sizes)) <= 2 and len(log.parts()[1]) < 6
    assert {v: log.table("artifacts", v).count() for v in list(lives)[::3]} == {v: lives[v] for v in list(lives)[::3]}
    assert log.table("artifacts", first).filter("superseded_by IS NOT NULL").isEmpty() and log.table("edges").isEmpty()
    for again in (log, StoreLog.open(spark, str(tmp_path / "log"))):
        rows = {r["id"]: r for r in again.table("artifacts").collect()}
        assert {k for k, r in rows.items() if r["superseded_by"]} == {f"a{k}" for k in range(9) if k != 1}
        assert {k for k, r in rows.items() if r["published"]} == {"b0", "a5"} and rows["b7"]["derived_from"] == ["a7"]
        assert again.table("blobs").count() == 21
        again.compact()
        assert again.parts()[1] == [] and again.table("artifacts").count() == 48
    with pytest.raises(LookupError):
        log.push(requests(spark, [("c", "nowhere", "x", None, None)]))
    with pytest.raises(LookupError):
        log.push(requests(spark, [("c", "s", "x", None, ["nothing"])]))
    with pytest.raises(ValueError):
        log.push(requests(spark, [("c", "s", " ", None, None)]))
    with pytest.raises(LookupError):
        log.table("artifacts", 999)
    assert log.version == max(lives)


def test_unfinished_writes_are_not_read(spark, tmp_path):
    log = StoreLog.create(spark, str(tmp_path / "log"))
    log.create_scopes(scopes(spark))
    log._record = None  # the process ends before the commit row
    with pytest.raises(TypeError):
        log.set_config({"a": "1"})
    again = StoreLog.open(spark, str(tmp_path / "log"))
    assert again.version == 1 and again.table("config").isEmpty()
    again.set_config({"a": "2"})
    assert again.store().get_config("a") == "2"


def test_sealed_contents_and_queries(spark, tmp_path):
    key, path = bytes(range(32)), str(tmp_path / "log")
    log = StoreLog.create(spark, path, key=key, embed=bag_of_words_embedder(32))
    log.create_scopes(scopes(spark))
    log.push(spark.createDataFrame([("s", "the cache is redis", "a secret harbour"), ("s", "another note", "a secret harbour"), ("s", "no content", None)], "scope string, summary string, content string"))
    stored = log.table("artifacts")
    assert "content" not in stored.columns and log.table("blobs").count() == 1
    data = b"".join(open(f, "rb").read() for f in glob.glob(f"{path}/**/*.parquet", recursive=True))
    bodies = b"".join(bytes(r["body"]) for r in log.table("blobs").collect())
    assert b"harbour" not in data + bodies and not any("redis" in r["summary"] for r in stored.collect())
    asked = spark.createDataFrame([("q", "s", "the cache is redis")], "query_id string, scope string, text string")
    again = StoreLog.open(spark, path, key=key, embed=bag_of_words_embedder(32))
    hit = again.query(asked, QuerySpec(top_k=1, detail=Detail.RAW)).first()
    assert (hit["summary"], hit["content"]) == ("the cache is redis", "a secret harbour")
    assert again.query(asked.withColumn("text", F.lit("harbour")), preset("hybrid")).first()["rank"] == 1
    assert {r["content"] for r in again.drill(stored.select("id")).collect()} == {"a secret harbour", None}
    for bad in (None, b"x" * 32):
        with pytest.raises(ValueError):
            StoreLog.open(spark, path, key=bad)
    for text in (key.hex(), base64.b64encode(key).decode(), key.hex().upper() + "\n"):
        assert read_key(text) == key
    assert read_key("k" * 32) == b"k" * 32
    with pytest.raises(ValueError):
        read_key("short")


def test_ids_are_in_the_order_they_were_made():
    ids = [new_id() for _ in range(70000)]
    assert ids == sorted(ids) and len(set(ids)) == len(ids) and {len(x) for x in ids} == {26}
