"""The string kernel against its definition, and the fitted machine on held-out labelled documents."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import held_out

SF = "/root/testdata/sf0.1"


def slow_kernel(a, b):
    """Sum over pairs of equal subsequences of three bytes, DECAY to the power of both spreads."""
    spots = [[(x, i) for i in combinations(range(len(x)), 3)] for x in (a, b)]
    return sum(toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1) for x, i in spots[0] for y, j in spots[1] if all(x[p] == y[q] for p, q in zip(i, j, strict=True)))


def test_kernel_against_its_definition():
    rng = np.random.default_rng(2)
    units = [bytes(rng.choice(list(b"abcd"), n).tolist()) for n in rng.integers(1, 10, 30)] + [b"", b"idiot", b"idiiot"]
    marks = units[5:12] + [b"idiot"]
    want = [[slow_kernel(u, m) for m in marks] for u in units]
    assert np.allclose(toxicity.kernel(toxicity.coded(units), toxicity.coded(marks)), want, rtol=1e-4)
    assert np.allclose(toxicity.self_kernel(toxicity.coded(units)), [slow_kernel(u, u) for u in units], rtol=1e-4)


@pytest.fixture(scope="module")
def machine(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return toxicity.fit(read("documents"), read("labels"))


def test_held_out_documents_of_each_language(spark, machine):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter(held_out(F.col("doc_id")))
    rows = docs.select("lang", "text", "toxic").toPandas()
    rows["hit"] = toxicity.document_scores(pa.array(rows["text"]), machine) >= 0.5
    toxic, clean = rows[rows["toxic"] == 1], rows[rows["toxic"] == 0]
    assert toxic["hit"].mean() >= 0.85 and clean["hit"].mean() <= 0.01
    caught = toxic.groupby("lang")["hit"].mean()
    assert caught["en"] >= 0.89 and caught.min() >= 0.6 and set(caught.index) == {"de", "en", "es", "fr"}


def test_disguised_insults_in_clean_documents(spark, machine):
    clean = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0"), "doc_id").filter(held_out(F.col("doc_id"))).filter("length(text) < 8000").orderBy("doc_id").limit(150)
    texts = [r["text"] for r in clean.collect()]
    insults = ["idiot", "stupid", "pathetic", "worthless"]
    for disguise, least in ((str, 1.0), (".".join, 0.9), (" ".join, 0.9), (" - ".join, 0.9), (lambda x: x[:2] + "*" + x[2:], 0.9), (lambda x: x[:3] + x[2:], 0.9)):
        marked = [f"{t[:200]} {disguise(insults[k % 4])} {disguise(insults[(k + 1) % 4])} {t[200:]}" for k, t in enumerate(texts)]
        assert (toxicity.document_scores(pa.array(marked), machine) >= 0.5).mean() >= least
    assert (toxicity.document_scores(pa.array(texts), machine) >= 0.5).mean() <= 0.02


def test_kept_scores_change_nothing(machine, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_UNITS", 5)
    for n in range(4):
        texts = pa.array([f"you idiot w{n}", "the garden grows", "", None, f"x{n} y{n} idiiot", "i d i o t " * 3000, "x" * 100_000])
        fresh = toxicity.Machine(*machine.plain())
        got = toxicity.document_scores(texts, machine)
        assert np.allclose(got, toxicity.document_scores(texts, fresh), atol=1e-6)
        assert got[2] == got[3] == got.min() and got[0] >= 0.5


def test_query_and_odd_tables(spark):
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(rows["doc_id"]) == sorted(r["doc_id"] for r in docs.select("doc_id").collect()) and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clash = docs.limit(5).withColumn("toxicity_score", F.lit("old"))
    again = toxicity.toxicity_scores(clash, docs, labels)
    assert again.columns == clash.columns and again.count() == 5
    assert toxicity.toxicity_scores(docs.limit(0), docs, labels).isEmpty()
    assert toxicity.toxicity_scores(docs.limit(5), docs.limit(0), labels.limit(0)).filter("toxicity_score <> 0").isEmpty()
