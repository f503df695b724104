"""Write verbs as frames of new rows; a store unions them in and lets the latest row win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_lines


def latest(log: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Of an append-only log the last row of each key that isn't a tombstone."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))
    rows = log.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", seq)
    return rows.filter(~F.col("deleted")).drop("deleted") if "deleted" in rows.columns else rows


def merge_lineage(derived: str, supersedes: str):
    """The two id lists, once each, without nulls, in order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(derived, none), F.coalesce(supersedes, none))))


def trust(meta, label):
    """meta without a trust the caller claims, with the one given; null if nothing is left."""
    kept = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda k, v: k != "trust")
    full = F.when(label.isNotNull() & (label != ""), F.map_concat(kept, F.create_map(F.lit("trust"), label))).otherwise(kept)
    return F.when(F.size(full) > 0, full)


def push(requests: DataFrame, artifacts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Requests (id, scope, kind, tier, summary, derived_from, supersedes) as new rows with their
    lineage, and (id, superseded_by) of the artifacts they replace. A request that names a
    missing artifact is refused before anything is written; without artifacts it isn't looked for."""
    pairs = requests.select("id", F.explode("supersedes").alias("target"))
    if artifacts is not None and not pairs.join(artifacts.select(F.col("id").alias("target")), "target", "left_anti").isEmpty():
        raise LookupError("supersedes an artifact that doesn't exist")
    rows = requests.withColumns({"kind": F.coalesce("kind", F.lit("insight")), "tier": F.coalesce("tier", F.lit("workspace")), "derived_from": merge_lineage("derived_from", "supersedes"), "published": F.lit(False)}).drop("supersedes")
    marks = pairs.filter("id <> target").groupBy(F.col("target").alias("id")).agg(F.max("id").alias("superseded_by"))
    return rows, marks


def fork(artifacts: DataFrame, source: str, target: str) -> DataFrame:
    """The published artifacts of source as unpublished workspace ones of target, derived from them."""
    rows = artifacts.filter((F.col("scope") == source) & F.col("published"))
    return rows.select(F.concat(F.lit("fork-"), "id").alias("id"), F.lit(target).alias("scope"), "kind", F.lit("workspace").alias("tier"), "summary", F.lit(False).alias("published"), F.array("id").alias("derived_from"), F.lit(None).cast("string").alias("superseded_by"))


def consolidate(scopes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (id, scope, summary, supersedes) as published worktree summaries in the scope's parent, or in a root itself."""
    found = requests.join(scopes.select(F.col("id").alias("scope"), "parent"), "scope")
    return found.select("id", F.coalesce("parent", "scope").alias("scope"), F.lit("summary").alias("kind"), F.lit("worktree").alias("tier"), "summary", F.lit(True).alias("published"), F.array_compact("supersedes").alias("derived_from"))


def seeds(requests: DataFrame) -> DataFrame:
    """Requests (scope, constraints, lessons) as one published worktree seed a line, in order."""
    lines = F.concat(content_lines(F.coalesce("constraints", F.lit(""))), content_lines(F.coalesce("lessons", F.lit(""))))
    rows = requests.select("scope", F.posexplode(lines).alias("at", "summary"))
    return rows.select("scope", F.col("at").cast("int").alias("at"), "summary", F.lit("seed").alias("kind"), F.lit("worktree").alias("tier"), F.lit(True).alias("published"))


def delete(artifacts: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of artifacts, and of edges, without those whose ids are gone."""
    left = artifacts.join(gone.select("id"), "id", "left_anti")
    kept = edges.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return left, kept.select(edges.columns)
