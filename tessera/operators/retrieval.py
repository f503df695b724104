"""Ranking of candidate sets: cosine, BM25, fusion, blends, graph boost, gate, rerank, verdict.

All operators take batches: rows carry a query_id, and statistics are per query. Ties fall to the
smaller artifact id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dot, rank_text_start, tokens
from tessera.operators import blocks, lexical
from tessera.operators import scopes as S
from tessera.operators.blocks import first
from tessera.session import cut
from tessera.spec import BM25_B, BM25_K1, DEFAULT_TOP, GRAPH_SEEDS, RECENCY_BASE, RECENCY_SHARE, RRF_K, Detail, Floors, QuerySpec


#: The trust that ingested text carries in its meta.
INGESTED = "ingested"


def order(score: str = "score"):
    return Window.partitionBy("query_id").orderBy(F.desc(score), "id")


def ranked(scored: DataFrame, score: str = "score", rank: str = "rank") -> DataFrame:
    return scored.withColumn(rank, F.row_number().over(order(score)))


def cosine(found: DataFrame, queries: DataFrame) -> DataFrame:
    """found with score; artifacts without a vector aren't ranked."""
    vectors = queries.select("query_id", "qvec")
    return found.filter("vec IS NOT NULL").join(vectors, "query_id").withColumn("score", dot(F.col("qvec"), F.col("vec"))).drop("qvec")


def corpus_stats(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (query_id, id, text): term counts by document, document counts by term, and sizes."""
    words = texts.select("query_id", "id", F.explode_outer(tokens(F.col("text"))).alias("term"))
    tf = words.filter("term IS NOT NULL").groupBy("query_id", "id", "term").agg(F.count("*").alias("f"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    lengths = words.groupBy("query_id", "id").agg(F.count("term").alias("dl"))
    sizes = lengths.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avg_len"))
    return tf, df, lengths.join(sizes, "query_id")


def bm25(texts: DataFrame, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, id, bm25 for every candidate of pairs (query_id, id); texts (id, text) are taken
    apart once each, and only terms that some query has go on. Without pairs, texts has the
    candidates itself (query_id, id, text). A candidate without a term of the query scores 0. A term
    that the query repeats counts as often as it stands there."""
    if pairs is None:
        own = texts.withColumn("id", F.struct("query_id", "id"))
        return bm25(own.drop("query_id"), queries, own.drop("text")).withColumn("id", F.col("id.id"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    words = texts.select("id", tokens(F.col("text")).alias("words"))
    pairs = cut(pairs.select("query_id", "id").join(words.select("id", F.coalesce(F.size("words"), F.lit(0)).alias("dl")), "id"))
    sizes = pairs.join(pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avg_len")), "query_id")
    terms = words.select("id", F.explode("words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("f"))
    hits = cut(pairs.select("query_id", "id").join(terms, "id").join(asked, ["query_id", "term"]))
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    rows = sizes.join(hits.join(df, ["query_id", "term"]), ["query_id", "id"], "left")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("f") * (BM25_K1 + 1) / (F.col("f") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avg_len")))
    return rows.groupBy("query_id", "id").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("bm25"))


def rrf(scored: DataFrame, *scores: str) -> DataFrame:
    """scored with fused: the sum of 1 / (k + rank) over the rankings by each score."""
    total: Column = F.lit(0.0)
    for name in scores:
        scored = ranked(scored, name, f"_{name}_rank")
        total = total + 1 / (RRF_K + F.col(f"_{name}_rank"))
    return scored.withColumn("fused", total).drop(*(f"_{name}_rank" for name in scores))


def recency(spec: QuerySpec) -> Column:
    """What an artifact's age adds; an unknown age adds nothing."""
    age = F.greatest((F.unix_micros(F.lit(spec.now).cast("timestamp")) - F.unix_micros("created_at")) / 86400e6, F.lit(0.0))
    return F.coalesce(RECENCY_SHARE * F.pow(F.lit(RECENCY_BASE), age / spec.recency_half_life_days), F.lit(0.0))


def importance(spec: QuerySpec) -> Column:
    return F.when(F.col("tier") == "worktree", min(spec.importance_weight, 1.0)).otherwise(0.0)


def blend(spec: QuerySpec) -> tuple[float, Column]:
    """The weight of the cosine in a vector query's order, and what an artifact adds to it."""
    if spec.importance_weight > 0:
        return 1 - min(spec.importance_weight, 1.0), importance(spec)
    if spec.recency_half_life_days > 0:
        return 1 - RECENCY_SHARE, recency(spec)
    return 1.0, F.lit(0.0)


def graph_boost(scored: DataFrame, edges: DataFrame, weight: float, incoming: str) -> DataFrame:
    """scored with sort_key: cosine blended with the links to the query's best candidates; where
    nothing is linked to them, the incoming order."""
    w = min(weight, 1.0)
    best = first(scored, GRAPH_SEEDS, F.desc("score"), "id").select("query_id", F.col("id").alias("seed"), F.col("score").alias("seed_score"))
    links = edges.select("from_id", "to_id", "kind").distinct()
    both = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("seed")).union(links.select("to_id", "from_id"))
    near = both.join(best, "seed").join(scored.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id", "id").agg(F.sum("seed_score").alias("g"))
    near = cut(near)
    return _by_links(scored.join(near, ["query_id", "id"], "left"), near, w, incoming)


def _by_links(scored: DataFrame, near: DataFrame, w: float, incoming: str) -> DataFrame:
    """scored (with g, null without links) with sort_key."""
    out = scored.join(near.groupBy("query_id").agg(F.max("g").alias("gmax")), "query_id", "left")
    mixed = (1 - w) * F.col("score") + w * F.coalesce("g", F.lit(0.0)) / F.col("gmax")
    return out.withColumn("sort_key", F.when(F.col("gmax") > 0, mixed).otherwise(F.col(incoming))).drop("g", "gmax")


def boosted(queries: DataFrame, reached: DataFrame, pool: DataFrame, edges: DataFrame, spec: QuerySpec, k: int) -> DataFrame:
    """query_id, id, score, sort_key of all that can be among the k best after graph_boost(): the best by
    cosine, and what is linked to the first of them. Only linked artifacts are looked at one by one."""
    weight, bonus = blend(spec)
    best = cut(blocks.topk(queries, reached, pool.withColumn("bonus", F.lit(0.0)), max(k, GRAPH_SEEDS)).select("query_id", "id", "score", "rank"))
    seeds = best.filter(F.col("rank") <= GRAPH_SEEDS).select("query_id", F.col("id").alias("seed"), F.col("score").alias("seed_score"))
    links = edges.select("from_id", "to_id", "kind").distinct()
    both = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("seed")).union(links.select("to_id", "from_id"))
    near = both.join(seeds, "seed").groupBy("query_id", "id").agg(F.sum("seed_score").alias("g"))
    near = near.join(pool.filter("vec IS NOT NULL").select("id", "scope", "published", "vec"), "id").join(reached, ["query_id", "scope"]).filter(F.col("any_state") | F.col("published"))
    near = cut(near.join(queries.select("query_id", "qvec"), "query_id").select("query_id", "id", dot(F.col("qvec"), F.col("vec")).alias("score"), "g"))
    others = best.select("query_id", "id", "score").join(near.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("g", F.lit(None).cast("double"))
    out = _by_links(near.unionByName(others), near, min(spec.graph_boost, 1.0), "score")
    if weight < 1:  # where nothing is linked, the order is that of the blend
        unlinked = queries.join(near.filter("g > 0").select("query_id").distinct(), "query_id", "left_anti")
        plain = blocks.topk(unlinked, reached, pool.withColumn("bonus", bonus), k, weight, spec.min_score if spec.min_score > 0 else None)
        out = out.join(unlinked.select("query_id"), "query_id", "left_anti").unionByName(plain.drop("rank", "scope"))
    return out


def borderline(scored: DataFrame, floors: Floors, key: str) -> DataFrame:
    """query_id, borderline: a weak top, or a cosine margin of the first two below the floor."""
    two = first(scored.drop("rank"), 2, F.desc(key), "id").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    weak = (F.col("top") < floors.floor) | F.coalesce(F.col("top") - F.col("second") < floors.margin, F.lit(False))
    return two.select("query_id", weak.alias("borderline"))


Reranker = Callable[[pd.Series, pd.Series], pd.Series]


def lexical_logits(query: pd.Series, text: pd.Series) -> pd.Series:
    """A stand-in cross-encoder: four times the share of the query's words in the text, less two."""
    out = []
    for q, t in zip(query, text, strict=True):
        asked = set(q.lower().split())
        out.append(4.0 * len(asked & set(t.lower().split())) / len(asked) - 2.0 if asked else -2.0)
    return pd.Series(out, dtype=float)


def rerank(scored: DataFrame, queries: DataFrame, reranker: Reranker, n: int, contents: DataFrame | None = None) -> DataFrame:
    """The n first of each query by sort_key, ordered by the reranker; rerank_score is its sigmoid."""
    window = ranked(scored, "sort_key").filter(F.col("rank") <= n).drop("rank").join(queries.select("query_id", F.col("text").alias("_asked")), "query_id")
    if "content" not in window.columns:
        window = window.join(contents, "id")
    logit = F.pandas_udf(reranker, "double")(F.col("_asked"), rank_text_start(F.col("kind"), F.col("content"), F.col("summary")))
    out = window.withColumn("sort_key", logit).drop("_asked")
    return out.withColumn("rerank_score", 1 / (1 + F.exp(-F.col("sort_key"))))


def retrieve(queries: DataFrame, scopes: DataFrame, artifacts: DataFrame, spec: QuerySpec, *, closure: DataFrame | None = None, rollups: DataFrame | None = None, edges: DataFrame | None = None, reranker: Reranker | None = None, index: lexical.Index | None = None, columns: tuple[str, ...] | None = None, with_paths: bool = True) -> DataFrame:
    """Hits of each query: its columns of artifacts (or those named, scope among them; without vectors, and
    contents only as raw detail), score (cosine), rerank_score, rank and scope_path. index: the inverted
    index of artifacts, which a hybrid query builds if it isn't given."""
    closure = S.closure(scopes) if closure is None else closure
    k = spec.top_k if spec.top_k > 0 else DEFAULT_TOP
    if spec.mode == "hybrid":
        out = _hybrid(queries, scopes, artifacts, spec, k, closure, rollups, edges, reranker, index or lexical.build(artifacts))
    else:
        out = _vector(queries, scopes, artifacts, spec, k, closure, rollups, edges, reranker)
    out = out.select("query_id", "id", "score", "rerank_score", "rank", *(["scope"] if "scope" in out.columns else []))
    if columns is None or not {*columns} <= {*out.columns}:
        more = artifacts.drop("vec", *([] if spec.detail >= Detail.RAW else ["content"]))
        out = out.drop("scope").join(more if columns is None else more.select("id", "scope", *(c for c in columns if c not in ("id", "scope"))), "id")
    return out.join(S.paths(scopes, closure), "scope", "left") if with_paths else out


def _vector(queries, scopes, artifacts, spec, k, closure, rollups, edges, reranker) -> DataFrame:
    """query_id, id, score, rerank_score, rank by cosine and blends: ranked in blocks, without a row for a pair."""
    reached = S.reached(queries, scopes, closure, spec, rollups)
    pool = S.current(S.of_tier(artifacts, spec), spec)
    least, none, (weight, bonus) = spec.min_score if spec.min_score > 0 else None, F.lit(None).cast("double"), blend(spec)

    def plain(of: DataFrame) -> DataFrame:
        if spec.graph_boost > 0 and edges is not None:
            found = boosted(of, reached, pool, edges, spec, k)
            return ranked(found if least is None else found.filter(F.col("score") >= least), "sort_key").filter(F.col("rank") <= k)
        return blocks.topk(of, reached, pool.withColumn("bonus", bonus), k, weight, least)

    def again(of: DataFrame) -> DataFrame:
        window = blocks.topk(of, reached, pool.withColumn("bonus", F.lit(0.0)), spec.rerank_n, 1.0, least).drop("rank", "scope")
        return ranked(rerank(window.join(artifacts.select("id", "kind", "summary", "content"), "id"), of, reranker, spec.rerank_n), "sort_key").filter(F.col("rank") <= k)

    if reranker is None or not (spec.rerank or spec.auto_rerank):
        out = plain(queries).withColumn("rerank_score", none)
    elif spec.rerank:
        out = again(queries)
    else:
        flags = cut(borderline(blocks.topk(queries, reached, pool.withColumn("bonus", F.lit(0.0)), 2), spec.floors, "score"))
        weak, sure = (queries.join(flags.filter(F.col("borderline") == x), "query_id", "left_semi") for x in (True, False))
        out = again(weak).select("query_id", "id", "score", "rerank_score", "rank").unionByName(plain(sure).withColumn("rerank_score", none).select("query_id", "id", "score", "rerank_score", "rank"))
    return out


def fuse(ranks: list[DataFrame]) -> DataFrame:
    """query_id, id, fused: the sum of 1 / (k + rank) over frames (query_id, id, rank) of the same rows."""
    each = reduce(DataFrame.unionByName, [r.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.lit(n).alias("of")) for n, r in enumerate(ranks)])
    of = [F.max(F.when(F.col("of") == n, 1 / (RRF_K + F.col("rank")))) for n in range(len(ranks))]  # added in order
    return each.groupBy("query_id", "id").agg(reduce(Column.__add__, of).alias("fused"))


def contenders(k: int) -> int:
    """How many of each of two rankings can be among the k first after fusion: the k-th of one ranking
    has 1 / (RRF_K + k) at least, what is beyond this many in both has less."""
    return 2 * k + RRF_K


def _hybrid(queries, scopes, artifacts, spec, k, closure, rollups, edges, reranker, index) -> DataFrame:
    """query_id, id, score, rerank_score, rank by the fused ranks of cosine and BM25. Only contenders get
    their ranks, which are counted; what decides are both rankings' first ones, what is linked to them,
    and, with a gate, the best of what passes it."""
    reached = cut(S.reached(queries, scopes, closure, spec, rollups))
    pool = cut(S.current(S.of_tier(artifacts, spec), spec).select("id", "scope", "published", "vec", F.lit(0.0).alias("bonus")))
    docs = S.current(S.of_tier(index.docs, spec), spec).filter("has_vec")
    asked = lexical.ask(index.postings, docs, queries, reached)
    reranking = reranker is not None and (spec.rerank or spec.auto_rerank)
    n = max(k, GRAPH_SEEDS if spec.graph_boost > 0 else 0, spec.rerank_n if reranking else 0)
    m = contenders(n)
    near = cut(blocks.topk(queries, reached, pool, m).select("query_id", "id", "score"))
    wanted = near.select("query_id", "id").union(lexical.best(asked, m).select("query_id", "id")).distinct()
    linked = spec.graph_boost > 0 and edges is not None
    if linked:
        links = edges.select("from_id", "to_id", "kind").distinct()
        seeds = near.join(first(near, GRAPH_SEEDS, F.desc("score"), "id").select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", F.col("id").alias("seed"))
        both = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("seed")).union(links.select("to_id", "from_id"))
        beside = both.join(seeds, "seed").select("query_id", "id").distinct().join(docs.select("id", "scope", "published"), "id").join(reached, ["query_id", "scope"]).filter(F.col("any_state") | F.col("published"))
        wanted = wanted.union(beside.select("query_id", "id")).distinct()
    by_cosine = cut(blocks.ranks(queries, reached, pool, wanted, per_query=2 * m))
    by_words = lexical.ranks(asked, by_cosine.select("query_id", "id", "id_rank"), 2 * m)
    scored = by_cosine.select("query_id", "id", "score").join(fuse([by_cosine.select("query_id", "id", "rank"), by_words]), ["query_id", "id"])
    scored = cut(scored.withColumn("sort_key", F.col("fused")))
    # The gate keeps a beginning of the ranking by cosine, so contenders stay contenders.
    passed = scored if spec.min_score <= 0 else scored.filter(F.col("score") >= spec.min_score)
    blended = graph_boost(scored, edges, spec.graph_boost, "sort_key") if linked else scored
    blended = (blended if spec.min_score <= 0 else blended.filter(F.col("score") >= spec.min_score)).withColumn("rerank_score", F.lit(None).cast("double"))
    out = blended
    if reranking:
        words = artifacts.select("id", "kind", "summary", "content")
        window = lambda of: first(of, spec.rerank_n, F.desc("sort_key"), "id").drop("rank").join(words, "id")
        if spec.rerank:
            out = rerank(window(passed), queries, reranker, spec.rerank_n)
        else:
            flags = cut(borderline(scored, spec.floors, "fused"))
            weak, sure = (flags.filter(F.col("borderline") == x).select("query_id") for x in (True, False))
            again = rerank(window(passed.join(weak, "query_id", "left_semi")), queries, reranker, spec.rerank_n)
            columns = ["query_id", "id", "score", "sort_key", "rerank_score"]
            out = again.select(columns).unionByName(blended.join(sure, "query_id", "left_semi").select(columns))
    return first(out, k, F.desc("sort_key"), "id")


def decide(hits: DataFrame, queries: DataFrame, floors: Floors) -> DataFrame:
    """query_id, confidence, weak_match, ranked_by, top_score, margin of each query's ranked hits."""
    one, two = F.col("rank") == 1, F.col("rank") == 2
    first = hits.groupBy("query_id").agg(*(F.max(F.when(at, F.col(c))).alias(f"{c}_{k}") for k, at in ((1, one), (2, two)) for c in ("score", "rerank_score")))
    row = queries.select("query_id").distinct().join(first, "query_id", "left")
    by_rerank = F.col("rerank_score_1").isNotNull()
    top = F.coalesce(F.col("rerank_score_1"), F.col("score_1"), F.lit(0.0))
    second = F.when(by_rerank, F.col("rerank_score_2")).otherwise(F.col("score_2"))
    margin = F.coalesce(top - second, F.lit(0.0))
    floor = F.when(by_rerank, floors.rerank).otherwise(floors.floor)
    verdict = F.when(F.col("score_1").isNull(), "empty").when(top < floor, "floor_miss").when(~by_rerank & second.isNotNull() & (margin < floors.margin), "margin_ambiguous").otherwise("ok")
    return row.select("query_id", verdict.alias("confidence"), (verdict != "ok").alias("weak_match"), F.when(by_rerank, "rerank").otherwise("cosine").alias("ranked_by"), top.alias("top_score"), margin.alias("margin"))


def respond(queries: DataFrame, hits: DataFrame, floors: Floors) -> DataFrame:
    """One row for each query: the verdict, whether ingested text is among the hits, and the hits in order."""
    one = F.struct("rank", "id", "scope", "kind", "score", "rerank_score")
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("hits"))  # top_k of them at most
    out = with_untrusted(decide(hits, queries, floors), hits).join(lists, "query_id", "left")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType)))


def as_json(rows: DataFrame) -> DataFrame:
    """rows as one JSON text each; fields that are null are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def traces(found: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, id, rank: what each query saw, and the rank of what it returned."""
    return found.select("query_id", "id").join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left")


def trace_totals(reached: DataFrame, pool: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, visible, hits, first: of each query's traces() how many there are, how many were returned, and
    the best. What a query sees is counted by scope and state; no trace is a row."""
    size = pool.groupBy("scope", "published").agg(F.count("*").alias("n"))
    seen = reached.join(size, "scope").filter(F.col("any_state") | F.col("published")).groupBy("query_id").agg(F.sum("n").alias("visible"))
    best = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min_by("id", "rank").alias("first"))
    return seen.join(best, "query_id", "left").select("query_id", "visible", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "first")


def with_untrusted(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """decisions with untrusted: whether a hit's meta says that it comes from ingested text."""
    flags = hits.groupBy("query_id").agg(F.bool_or(F.coalesce(F.col("meta")["trust"] == INGESTED, F.lit(False))).alias("untrusted"))
    return decisions.join(flags, "query_id", "left").withColumn("untrusted", F.coalesce("untrusted", F.lit(False)))
