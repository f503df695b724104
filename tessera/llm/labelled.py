"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out


def sampled_documents(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """text and label of the documents of at most per_class doc_ids of each label, which the hash of
    doc_id chooses among all labelled ones outside the held-out fifth, each different text once; and
    how many labelled doc_ids there are of each label. Rows with nulls are left out."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    of_class = lambda k: ids.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = of_class(0).union(of_class(1))  # two classes of per_class ids: that is the bound of the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropna()
    once = rows.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min(F.struct("doc_id")).alias("k")).select("h", "label", F.col("k.doc_id").alias("doc_id"))
    rows = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(once), ["h", "label", "doc_id"], "left_semi")
    return rows.select("text", "label"), total
