"""The given tables as scopes, artifacts, edges, rollups and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(n) -> "F.Column":
    return F.lpad(n.cast("string"), 10, "0")


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root, a scope for each language, one for each source in it; src3 is archived."""
    pairs = read(spark, sf_dir, "documents").select("lang", "source").distinct()
    root = spark.range(1).select(F.lit("R").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("worktree").alias("role"), F.lit("corpus").alias("title"), F.lit(False).alias("archived"))
    langs = pairs.select("lang").distinct().select(F.concat(F.lit("R/"), "lang"), F.lit("R"), F.lit("workspace"), "lang", F.lit(False))
    leaves = pairs.select(F.concat_ws("/", F.lit("R"), "lang", "source"), F.concat(F.lit("R/"), "lang"), F.lit("session"), "source", F.col("source") == "src3")
    return root.union(langs).union(leaves)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors, labels = (read(spark, sf_dir, t) for t in ("documents", "embeddings", "labels"))
    n = vectors.agg(F.count("*").alias("n"))
    kinds = F.array(*(F.lit(k) for k in ("answer", "insight", "summary", "document", "reasoning", "seed")))
    # The next copy of a text supersedes it: copies meet by the text's hash, not by the text.
    next_copy = F.lead(padded(F.col("doc_id"))).over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))
    chain = docs.select("doc_id", next_copy.alias("superseded_by")).filter("superseded_by IS NOT NULL")
    d = docs.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("doc_id") % F.col("n"))
    d = d.join(vectors.select("vec_id", F.col("embedding").alias("vec")), "vec_id").join(labels.select("doc_id", "quality"), "doc_id", "left").join(chain, "doc_id", "left")
    return d.select(
        padded(F.col("doc_id")).alias("id"), F.concat_ws("/", F.lit("R"), "lang", "source").alias("scope"), F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("kind"),
        F.when(F.col("quality") == 1, "worktree").otherwise("workspace").alias("tier"), F.substring("text", 1, 80).alias("summary"), F.col("text").alias("content"),
        (F.col("doc_id") % 3 == 0).alias("published"), "vec", F.when(F.col("source") == "src2", F.create_map(F.lit("trust"), F.lit("ingested"))).alias("meta"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, doc_id, 0, 0)").alias("created_at"), "superseded_by",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg(F.count("*").alias("n"))
    far = F.pmod(F.col("doc_id") * 7 + 3, F.col("n"))
    depends = docs.filter("doc_id > 0").select(padded(F.col("doc_id")).alias("from_id"), padded(F.floor(F.col("doc_id") / 2)).alias("to_id"), F.lit("depends_on").alias("kind"))
    relates = docs.crossJoin(F.broadcast(n)).filter((F.col("doc_id") % 4 == 0) & (far != F.col("doc_id"))).select(padded(F.col("doc_id")), padded(far), F.lit("relates_to"))
    refines = artifacts(spark, sf_dir).filter("superseded_by IS NOT NULL").select("superseded_by", "id", F.lit("refines"))
    return depends.union(relates).union(refines)


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).groupBy("scope").agg(F.min_by("vec", "id").alias("rollup_vec"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, with the text of a benchmark item, from one of three viewpoints."""
    e, b = read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0"), read(spark, sf_dir, "benchmark")
    n = b.agg(F.count("*").alias("n"))
    e = e.crossJoin(F.broadcast(n)).withColumn("item_id", F.floor(F.col("vec_id") / 50) % F.col("n"))
    scope = F.when(F.col("vec_id") % 3 == 0, "R").when(F.col("vec_id") % 3 == 1, "R/en").otherwise("R/en/src1")
    return e.join(b, "item_id").select(F.concat(F.lit("q"), padded(F.col("vec_id"))).alias("query_id"), scope.alias("scope"), "text", F.col("embedding").alias("qvec"))


def tree_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep scope tree: regions, nations, customers."""
    root = spark.range(1).select(F.lit("G").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("globe").alias("title"))
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("G"), "r_name")
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name")
    return root.union(r).union(n).union(c)
