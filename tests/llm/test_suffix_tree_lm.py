"""Suffix-tree scores against a plain tree of dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_tree_lm as M


def spelled(text):
    words = (text or "").encode().lower().split()
    return [*(w + b" " for w in words), b"\n"]


class Plain:
    """The tree by its definition."""

    def __init__(self, texts, share):
        self.n, self.words = defaultdict(Counter), Counter()
        for text in texts:
            tokens = spelled(text)
            self.words.update(tokens)
            raw = b"\n" * M.CONTEXT + b"".join(tokens)
            for i in range(M.CONTEXT, len(raw)):
                for d in range(M.CONTEXT + 1):
                    self.n[raw[i - d : i]][raw[i]] += 1
        self.places = sum(self.n[b""].values())
        least = max(M.LEAST, self.places * share)
        self.kept = {s: {b: k for b, k in c.items() if k >= least or not s} for s, c in self.n.items()}
        self.total = {s: sum(c.values()) for s, c in self.n.items()}
        self.states = {b""}
        for s, kept in self.kept.items():
            if s and kept:
                t, pt, up = self.total[s], self.total[s[1:]], self.kept[s[1:]]
                gain = sum(k * math.log(k / t * pt / up[b]) for b, k in kept.items())
                rest, prest = 1 - sum(k / t for k in kept.values()), 1 - sum(up[b] / pt for b in kept)
                if rest > 1e-9 and prest > 1e-9:
                    gain += t * rest * math.log(rest / prest)
                if gain > len(kept) / 2 * math.log(t):
                    self.states |= {s[k:] for k in range(len(s))}

    def p(self, s, b):
        if not s:
            return (self.kept.get(b"", {}).get(b, 0) + 1) / (self.places + 256)
        kept, t = self.kept[s], self.total[s]
        weight = (t - sum(kept.values()) + len(kept)) / (t + len(kept))
        return kept.get(b, 0) / (t + len(kept)) + weight * self.p(s[1:], b)

    def state(self, before):
        return next(before[len(before) - d :] for d in range(M.CONTEXT, -1, -1) if before[len(before) - d :] in self.states)

    def score(self, text):
        raw, out = b"\n" * M.CONTEXT, 0.0
        for token in spelled(text):
            p = 1.0
            for b in token:
                p *= self.p(self.state(raw[-M.CONTEXT :]), b)
                raw += bytes([b])
            n, once = sum(self.words.values()), sum(k == 1 for k in self.words.values())
            new, c = (once + 1) / (n + 2), self.words[token]
            out += math.log10((1 - new) * (M.WHOLE * c / n + (1 - M.WHOLE) * p) if c else new)
        return out

    def base(self, text):
        n, v = sum(self.words.values()), len(self.words)
        return sum(math.log10((self.words[t] + 1) / (n + v + 1)) for t in spelled(text))


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' WHERE n_chars < 900 ORDER BY doc_id LIMIT 60").fetchall()
    return [*rows, (9001, ""), (9002, None), (9003, " \t\n"), (9004, "naïve \x0bÉtÉ"), (9004, "naïve \x0bÉtÉ"), (9005, "z" * 3000), (None, "the end"), (9006, "\x00\x01 \x07" * 4)]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("share", [2.0**-22, 2.0**-9])
def test_scores_equal_a_plain_tree(spark, texts, monkeypatch, share):
    monkeypatch.setattr(M, "SHARE", share)
    plain = Plain([t for k, t in texts if not held(k)], share)
    df = spark.createDataFrame([(*r, "clash") for r in texts], "doc_id long, text string, score string").withColumn("held_out", M.held_out(F.col("doc_id")))
    got = M.score(df, M.fit(df)).collect()
    want = sorted((str(k), held(k), len(spelled(t)), sum(plain.words[x] > 0 for x in spelled(t)), round(plain.base(t), 6), round(plain.score(t), 3)) for k, t in texts if (t or "") != "z" * 3000)
    rows = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in got if r["doc_id"] != 9005)
    assert len(got) == len(texts) and [r[:4] for r in rows] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in rows], [r[4:] for r in want], atol=2e-3)
    assert all(r["train_tokens"] == sum(plain.words.values()) for r in got) and all(math.isfinite(r["score"]) for r in got)


def test_probabilities_of_a_place_sum_to_one(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("held_out", F.lit(False))
    tree = M.fit(df).tree
    places = M.grams(*M.spelled(M.tokens(pa.array([t for _, t in texts[:5]])))[:2])[::37]
    for g in places:
        every = (np.full(256, g) & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** tree.log10(every)).sum() - 1) < 1e-5


def test_no_training_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    row = M.score(docs, M.fit(docs)).first()
    assert row["n_known"] == 0 and row["base_score"] == 0 and row["train_tokens"] == 0
    assert abs(row["score"] - 3 * math.log10(0.5)) < 1e-6
    assert M.score(docs.limit(0), M.fit(docs.limit(0))).collect() == []


def test_held_out_texts_score_above_the_base(spark):
    rows = M.op13_suffix_tree_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert rows["n"] > 100 and rows["s"] > 0.9 * rows["b"]


def scores_of_plain(spark, texts, plain):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("held_out", M.held_out(F.col("doc_id")))
    got = sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6), r["score"]) for r in M.score(df, M.fit(df)).collect())
    want = sorted((str(k), sum(plain.words[x] > 0 for x in spelled(t)), round(plain.base(t), 6), plain.score(t)) for k, t in texts)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=2e-3)


@pytest.fixture
def whole(texts, monkeypatch):
    """Texts, and their plain tree with all runs, those that are met once too."""
    texts = [(k, t) for k, t in texts if k != 9005]
    with monkeypatch.context() as m:
        m.setattr(M, "LEAST", 1)
        return texts, Plain([t for k, t in texts if not held(k)], 0)


def test_the_rarest_runs_count(spark, whole):
    scores_of_plain(spark, *whole)


@pytest.mark.parametrize("share", [2.0**-22, 2.0**-9])
def test_runs_and_words_that_are_not_broadcast(spark, whole, monkeypatch, share):
    monkeypatch.setattr(M, "RUNS", 64)
    monkeypatch.setattr(M, "COMMON", share)
    scores_of_plain(spark, *whole)


def test_a_large_corpus_keeps_its_rare_runs(spark):
    """14 million places, so that a share of 2 ** -22 of them is more than the two of a run."""
    docs = [(0, "qzxvy " * 2), *((k, "common words " * 3000) for k in range(1, 370))]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", F.lit(False))
    tree = M.fit(docs).tree
    assert tree.log10(np.array([int.from_bytes(b" qzxvy", "big")], np.uint64))[0] > math.log10(0.5)
