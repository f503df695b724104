"""The scope tree: closure, paths, and the candidate sets of a viewpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dot
from tessera.operators.chains import walks
from tessera.spec import COARSE_LEAST, COARSE_MARGIN, QuerySpec

#: Lists that the queries of a scope are cut into; tasks for each core that candidates are dealt to.
LISTS, DEALT = 64, 8


def closure(scopes: DataFrame) -> DataFrame:
    """ancestor, descendant, distance: all pairs on a path to the root, each scope itself at 0.

    The paths double each round; a walk ends at a root, a missing parent or a scope it has been at."""
    links = scopes.join(scopes.select(F.col("id").alias("parent")), "parent").select("id", F.col("parent").alias("next"))
    return walks(scopes, links).select(F.col("id").alias("ancestor"), F.col("origin").alias("descendant"), F.col("step").alias("distance"))


def ancestors(closure: DataFrame) -> DataFrame:
    return closure.filter("distance > 0").select(F.col("descendant").alias("scope"), "ancestor", "distance")


def descendants(closure: DataFrame) -> DataFrame:
    return closure.filter("distance > 0").select(F.col("ancestor").alias("scope"), "descendant", "distance")


def siblings(scopes: DataFrame) -> DataFrame:
    """Pairs under one parent; root scopes are each other's siblings."""
    a, b = scopes.select(F.col("id").alias("scope"), "parent"), scopes.select(F.col("id").alias("sibling"), F.col("parent").alias("p"), "archived")
    return a.join(b, F.col("parent").eqNullSafe(F.col("p")) & (F.col("scope") != F.col("sibling"))).select("scope", "sibling", "archived")


def paths(scopes: DataFrame, closure: DataFrame) -> DataFrame:
    """scope, scope_path: titles (or roles, where empty) from the root down."""
    label = F.when(F.coalesce("title", F.lit("")) == "", F.col("role") if "role" in scopes.columns else F.lit("")).otherwise(F.col("title"))
    steps = closure.join(scopes.select(F.col("id").alias("ancestor"), label.alias("label")), "ancestor")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "label")))
    return steps.groupBy(F.col("descendant").alias("scope")).agg(F.array_join(F.transform(ordered, lambda x: x["label"]), "/").alias("scope_path"))


def _reached(queries: DataFrame, scopes: DataFrame, closure: DataFrame, spec: QuerySpec, down: bool) -> DataFrame:
    """query_id, scope, any_state: scopes seen from each query's viewpoint; any_state: whether
    unpublished artifacts of it are seen too."""
    views = queries.select("query_id", F.col("scope").alias("view"))
    current = F.lit(True) if spec.include_superseded else ~F.col("archived")
    own = views.select("query_id", F.col("view").alias("scope"), F.lit(True).alias("any_state"))
    up = views.join(ancestors(closure), F.col("view") == F.col("scope")).select("query_id", F.col("ancestor").alias("scope"), F.lit(True))
    side = views.join(siblings(scopes), F.col("view") == F.col("scope")).filter(current).select("query_id", F.col("sibling").alias("scope"), F.lit(False))
    out = own.union(up).union(side)
    if down:
        below = views.join(descendants(closure), F.col("view") == F.col("scope")).select("query_id", F.col("descendant").alias("id"))
        out = out.union(below.join(scopes.select("id", "archived"), "id").filter(current).select("query_id", "id", F.lit(True)))
    return out.groupBy("query_id", "scope").agg(F.bool_or("any_state").alias("any_state"))


def coarse_scopes(queries: DataFrame, scopes: DataFrame, closure: DataFrame, rollups: DataFrame, spec: QuerySpec) -> DataFrame:
    """query_id, scope, score, rank: the descendant scopes whose rollups are near the query."""
    below = queries.join(descendants(closure), "scope").select("query_id", "qvec", F.col("descendant").alias("id"))
    below = below.join(scopes.select("id", "archived"), "id").filter(F.lit(spec.include_superseded) | ~F.col("archived"))
    scored = below.join(rollups.filter("rollup_vec IS NOT NULL"), below["id"] == rollups["scope"]).select("query_id", F.col("id").alias("scope"), dot(F.col("qvec"), F.col("rollup_vec")).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "scope")
    ranked = scored.withColumns({"rank": F.row_number().over(by), "top": F.max("score").over(Window.partitionBy("query_id"))})
    k = spec.coarse_k if spec.coarse_k > 0 else 6
    kept = (F.col("rank") <= k) & ((F.col("rank") <= COARSE_LEAST) | (F.col("score") >= F.col("top") - COARSE_MARGIN))
    return ranked.filter(kept).select("query_id", "scope", "score", "rank")


def reached(queries: DataFrame, scopes: DataFrame, closure: DataFrame, spec: QuerySpec, rollups: DataFrame | None = None) -> DataFrame:
    """query_id, scope, any_state: the scopes of each query's candidate set."""
    if spec.candidates == "hierarchical" and rollups is not None:
        coarse = coarse_scopes(queries, scopes, closure, rollups, spec).select("query_id", "scope")
        routed = coarse.select("query_id").distinct()
        picked = coarse.union(queries.select("query_id", "scope").join(routed, "query_id", "left_semi")).distinct().withColumn("any_state", F.lit(True))
        return picked.union(_reached(queries.join(routed, "query_id", "left_anti"), scopes, closure, spec, down=False))
    return _reached(queries, scopes, closure, spec, down=spec.candidates == "collapsed")


def of_tier(artifacts: DataFrame, spec: QuerySpec) -> DataFrame:
    return artifacts.filter(F.col("tier") == spec.tier) if spec.tier else artifacts


def candidates(queries: DataFrame, scopes: DataFrame, artifacts: DataFrame, closure: DataFrame, spec: QuerySpec, rollups: DataFrame | None = None) -> DataFrame:
    """query_id and the artifacts in its candidate set, before currency and kind are looked at. There are few
    scopes, so artifacts don't meet queries by scope in a shuffle: they are dealt by id, and each scope's
    queries come as lists to where its artifacts are."""
    asked = reached(queries, scopes, closure, spec, rollups).groupBy("scope", "any_state", F.pmod(F.xxhash64("query_id"), F.lit(LISTS)).alias("part")).agg(F.collect_list("query_id").alias("asked")).drop("part")
    dealt = of_tier(artifacts, spec).repartition(DEALT * artifacts.sparkSession.sparkContext.defaultParallelism, "id")
    found = dealt.join(F.broadcast(asked), "scope").filter(F.col("any_state") | F.col("published"))
    return found.select(F.explode("asked").alias("query_id"), *artifacts.columns)


def current(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """The currency and kind filters."""
    found = found if spec.include_superseded else found.filter("superseded_by IS NULL")
    return found.filter(F.col("kind").isin(*spec.kinds)) if spec.kinds else found


def sibling_overview(views: DataFrame, scopes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """scope (the viewpoint) and the published artifacts of its siblings, archived and superseded ones too."""
    near = views.select(F.col("scope").alias("view")).distinct().join(siblings(scopes), F.col("view") == F.col("scope")).select("view", "sibling")
    return artifacts.filter("published").join(near, artifacts["scope"] == near["sibling"]).drop("sibling")
