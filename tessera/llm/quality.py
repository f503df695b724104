"""Operator 1: a quality classifier by Bradley-Terry pairwise ranking.

A document's features are shares of its bytes and words (capitals, marks, table bars, digits,
repeated neighbours ...). Weights are learned from all preference pairs, one labelled document of
either label each: the logistic loss of the difference of their features. Tasks sum the features of
all labelled documents by label and narrow bins of the present score, which is what a Newton step
over the pairs needs. The threshold is a quantile of the scores of all labelled documents, at the
share of label 0 among them; scores are mapped to 0..1 so that it lies at 0.3.

A null text counts as empty; an empty text has features of 0 and a score like any other. Null and
repeated doc_ids are kept; without labels of both kinds every score is 0.3. Texts of any length
are read whole. Other columns pass through quality_scores() unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Words, held_out, slices, stored, table, text_bytes

#: The threshold's score; bins of scores and Newton steps of the fit; the largest feature.
CUT, BINS, STEPS, MOST = 0.3, 1024, 30, 3.0

_KIND = np.full(256, 7, np.uint8)  # 0 small letter, 1 capital, 2 digit, 3 space, 4 stop, 5 !, 6 |, 7 other mark
_KIND[97:123] = _KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 13, 32]] = 3
_KIND[[ord(x) for x in ".,;:'\"?()-"]] = 4
_KIND[ord("!")], _KIND[ord("|")] = 5, 6


def features(texts: pa.Array) -> np.ndarray:
    """A row of shares for each text."""
    raw, ends = text_bytes(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(ends))
    kinds = np.bincount(doc * 8 + _KIND[raw], minlength=8 * n).reshape(n, 8) / np.maximum(np.diff(ends), 1)[:, None]
    words = Words(texts)
    count = np.maximum(words.count, 1)

    def lag(k: int) -> np.ndarray:
        same = (words.hash[k:] == words.hash[:-k]) & (words.doc[k:] == words.doc[:-k])
        return np.bincount(words.doc[k:][same], minlength=n) / count

    length = np.bincount(words.doc, words.ends - words.starts, n) / count
    shares = [kinds[:, 1], kinds[:, 2], kinds[:, 4], kinds[:, 5], kinds[:, 6], kinds[:, 7], lag(1), lag(2), lag(3)]
    return np.stack([*(np.minimum(x * 10, MOST) for x in shares), np.minimum(length / 10, MOST)], axis=1)


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, x (features) of all labelled documents outside the held-out fifth, each different text of a doc_id once.
    Rows with nulls are left out. Texts aren't shuffled, their features are."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).dropna().filter(~held_out(F.col("doc_id")))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), part.column("h"), pa.array(features(part.column("text")).tolist(), pa.list_(pa.float64()))], names=["doc_id", "h", "x"])

    return stored(rows.mapInArrow(run, "doc_id long, h long, x array<double>").dropDuplicates(["doc_id", "h"]).join(ids, "doc_id").filter("label IN (0, 1)").select("label", "x"))


def _arrays(batches):
    """label and matrix of each batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column("label").to_numpy(), np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, w: np.ndarray) -> dict[int, np.ndarray]:
    """Of each label and bin of scores: the number of documents, and the sums of their features and of these' products."""
    n = len(w)
    low, width = float(np.minimum(w * MOST, 0).sum()), float(np.abs(w * MOST).sum()) / BINS or 1.0
    upper = np.triu_indices(n)

    def run(batches):
        sums = {}
        for label, x in _arrays(batches):
            cell = label * BINS + np.clip((x @ w - low) / width, 0, BINS - 1).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            at = np.flatnonzero(np.diff(cell[order], prepend=-1))
            x = x[order]
            every = np.add.reduceat(np.hstack((np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None, :])[:, upper[0], upper[1]])), at)
            for k, c in enumerate(cell[order][at].tolist()):
                sums[c] = sums[c] + every[k] if c in sums else every[k]
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["cell", "v"])

    parts = rows.mapInArrow(run, "cell long, v array<double>")
    size = 1 + n + len(upper[0])
    found = parts.groupBy("cell").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(size))).alias("v")).collect()  # 2 * BINS at most
    out = {}
    for k in (0, 1):
        out[k] = np.array([r["v"] for r in sorted(found, key=lambda r: r["cell"]) if r["cell"] // BINS == k]).reshape(-1, size)
    return out


def _step(sums: dict[int, np.ndarray], w: np.ndarray) -> np.ndarray:
    """A Newton step of the mean logistic loss of all pairs of a document of either label, whose scores are taken as
    the means of their bins."""
    n = len(w)

    def parts(of):
        square = np.zeros((len(of), n, n))
        square[(slice(None), *np.triu_indices(n))] = of[:, 1 + n :]
        return of[:, 0], of[:, 1 : 1 + n], square + np.triu(square, 1).transpose(0, 2, 1)

    (n0, x0, xx0), (n1, x1, xx1) = parts(sums[0]), parts(sums[1])
    miss = 1 / (1 + np.exp(np.clip((x1 @ w / n1)[:, None] - (x0 @ w / n0)[None, :], -30, 30)))
    curve, pairs = miss * (1 - miss), n0.sum() * n1.sum()
    pull = x1.T @ (miss @ n0) - x0.T @ (miss.T @ n1)
    cross = x1.T @ curve @ x0
    bend = np.tensordot(curve @ n0, xx1, 1) + np.tensordot(curve.T @ n1, xx0, 1) - cross - cross.T
    return np.linalg.solve(bend / pairs + 0.01 * np.eye(n), pull / pairs - 0.01 * w)


def _next_two(scores: DataFrame, k: int) -> tuple[float, float]:
    """The k-th smallest s (from 0) and the one after it (or itself, if it is the last), by counts of ever narrower bins."""
    s, part, before = F.col("s"), scores, 0
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while (width := (high - low) / BINS) > 0:
        bins = part.groupBy(F.least(F.floor((s - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("low").collect()  # BINS at most
        for b in bins:
            if k < before + b["n"]:
                break
            before += b["n"]
        part = scores.filter((s >= b["low"]) & (s <= b["high"]))
        if (b["low"], b["high"]) == (low, high):
            break
        low, high = b["low"], b["high"]
    for r in part.groupBy("s").agg(F.count("*").alias("n")).orderBy("s").collect():  # one number, or neighbouring ones
        low = r["s"]
        if k + 1 < before + r["n"]:
            return low, low
        before += r["n"]
        if k < before:
            break
    after = scores.filter(s > low).agg(F.min("s")).first()[0]
    return low, low if after is None else after


def fit(rows: DataFrame) -> tuple[list[float], float, float] | None:
    """Weights, threshold and scale from all rows (label, x); None without both labels."""
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    w = np.zeros(len(rows.first()["x"]))
    for _ in range(STEPS):
        step = _step(_sums(rows, w), w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break

    def score(batches):
        for _, x in _arrays(batches):
            yield pa.record_batch([pa.array(x @ w)], names=["s"])

    scores = stored(rows.mapInArrow(score, "s double"))
    # As many documents lie below the threshold as have label 0.
    low, high = _next_two(scores, min(size[0] - 1, size[0] + size[1] - 2))
    return w.tolist(), (low + high) / 2, max(scores.agg(F.stddev_pop("s")).first()[0] / 2, 1e-6)


def quality_scores(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with quality_score; labelled (doc_id, text) holds the texts that labels speak of."""
    model = fit(labelled_features(labelled, labels))
    docs = docs.drop("quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])
    base = float(np.log(CUT / (1 - CUT)))

    def run(batches):
        for batch in batches:
            for rows in slices(batch, text):
                if model:
                    w, cut, scale = model
                    z = (features(rows.column(text)) @ np.array(w) - cut) / scale + base
                    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                else:
                    score = np.full(rows.num_rows, CUT)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], names=[*rows.schema.names, "quality_score"])

    return docs.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = quality_scores(docs, docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
