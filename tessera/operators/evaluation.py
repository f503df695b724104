"""Calibration, abstention, recall, wall runs and scenario turns over ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains_any, word_count


def conformal_floor(tops: DataFrame, coverage: float) -> DataFrame:
    """One row: the quantile of top scores that leaves coverage above it, within 0..1."""
    q = F.percentile("top_score", F.lit(1 - coverage))
    return tops.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)).alias("floor"), F.count("*").alias("probes"))


def abstention(decisions: DataFrame) -> DataFrame:
    """Of decisions with present: weak verdicts where an answer is there (fnr) and ok ones where none is (fpr)."""
    present, weak = F.col("present"), F.col("weak_match")
    rate = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit), F.count_if(of)), F.lit(0.0))
    return decisions.agg(
        F.count_if(present).alias("n_present"), F.count_if(~present).alias("n_absent"), F.count_if(present & weak).alias("weak_present"), F.count_if(~present & weak).alias("weak_absent"),
        rate(present & weak, present).alias("fnr"), rate(~present & ~weak, ~present).alias("fpr"), F.coalesce(F.max(F.when(~present, F.col("top_score"))), F.lit(0.0)).alias("max_absent"),
    )


def gold_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, gold, rank: where each gold artifact stands; 0 if it isn't among the hits."""
    return gold.join(hits.select("query_id", F.col("id").alias("gold"), "rank"), ["query_id", "gold"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def wall_report(ranks: DataFrame, k: int) -> DataFrame:
    best = ranks.groupBy("query_id").agg(F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("best"))
    return best.agg(F.count("*").alias("questions"), F.count_if(F.col("best") <= k).alias("found"), F.coalesce(F.avg((F.coalesce("best", F.lit(k + 1)) <= k).cast("double")), F.lit(0.0)).alias("recall"), F.avg("best").alias("mean_rank"))


def hit_lists(hits: DataFrame) -> DataFrame:
    """query_id, hits: the ranked hits of each query (top_k at most) as one list."""
    one = F.struct(*(c for c in ("rank", "id", "summary", "content") if c in hits.columns))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("hits"))


def _with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    lists = hit_lists(hits)
    out = rows.join(lists, "query_id", "left")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType)))


def _rank_of(id: Column) -> Column:
    """Where id stands in hits; 0 if it doesn't."""
    return F.coalesce(F.array_position(F.transform("hits", lambda h: h["id"]), id), F.lit(0)).cast("int")


def packets(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """All that a blind judge sees: query_id, question, and the summaries of the hits in order."""
    asked = queries.select("query_id", F.col("text").alias("question"))
    return _with_hits(asked, hits).select("query_id", "question", F.transform("hits", lambda h: h["summary"]).alias("retrieved"))


def wall_gold(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """What is withheld from the judge, of gold (query_id, refs, current, stale): where each reference
    stands, and whether the current artifact of a probe is found and above the stale one. Where a
    question has no probe (no current), its ranks and currency_ok are null."""
    rows = _with_hits(gold, hits).withColumn("ref_ranks", F.transform(F.coalesce("refs", F.array().cast("array<string>")), _rank_of))
    now, old, probed = F.col("current_rank"), F.col("stale_rank"), F.col("current").isNotNull()
    rows = rows.withColumns({"current_rank": F.when(probed, _rank_of(F.col("current"))), "stale_rank": F.when(probed, _rank_of(F.col("stale")))})
    return rows.select("query_id", "refs", "ref_ranks", F.exists("ref_ranks", lambda r: r > 0).alias("gold_found"), "current_rank", "stale_rank", ((now > 0) & ((old == 0) | (now < old))).alias("currency_ok"))


def wall_summary(golds: DataFrame) -> DataFrame:
    recall = F.coalesce(F.try_divide(F.count_if("gold_found"), F.count("*")), F.lit(0.0))
    return golds.agg(F.count("*").alias("questions"), recall.alias("gold_recall"), F.count("currency_ok").alias("currency_probes"), F.count_if("currency_ok").alias("currency_ok"))


def turn_metrics(turns: DataFrame, hits: DataFrame, artifacts: DataFrame) -> DataFrame:
    """How well the hits (with content) of each turn (query_id, expect) meet what it expects: a
    target artifact among them, a mention of some term, none of a forbidden one, at once or after
    at most max_drills looks into contents; baseline: artifacts that would be read without a store.
    expect is a struct of target, mentions, forbid, max_drills, baseline, or null for none."""
    rows = _with_hits(turns, hits)
    e, none, expected = F.col("expect"), F.array().cast("array<string>"), F.col("expect").isNotNull()
    target, mentions, forbid, most = e["target"], F.coalesce(e["mentions"], none), F.coalesce(e["forbid"], none), F.coalesce(e["max_drills"], F.lit(0))
    aimed, named = F.coalesce(target != "", F.lit(False)), F.size(mentions) > 0
    words = lambda parts, name: F.aggregate(parts, F.lit(0), lambda s, h: s + word_count(F.coalesce(h[name], F.lit(""))))
    tells = lambda name: F.transform("hits", lambda h: F.coalesce(contains_any(h[name], mentions), F.lit(False)))
    rows = rows.withColumns({
        "overview_tokens": words(F.col("hits"), "summary"),
        "_target_rank": _rank_of(target),
        "_told_rank": F.array_position(tells("summary"), F.lit(True)).cast("int"),
        "_drill_rank": F.array_position(tells("content"), F.lit(True)).cast("int"),
        "forbid_ok": ~expected | ~F.exists("hits", lambda h: F.coalesce(contains_any(h["summary"], forbid), F.lit(False))),
    })
    rank = F.when(~expected, 0).when(aimed, F.col("_target_rank")).when(named, F.col("_told_rank")).otherwise(0)
    fits = (~aimed | (F.col("_target_rank") > 0)) & F.col("forbid_ok")
    said = ~named | (F.col("_told_rank") > 0)
    later = fits & F.col("_drill_rank").between(1, most)
    rows = rows.withColumns({"expected_rank": rank, "sufficient": expected & fits & said, "_later": expected & later})
    drills = F.when(~expected | F.col("sufficient") | (most <= 0), 0).when(F.col("_later"), F.col("_drill_rank")).otherwise(F.least(F.size("hits"), most))
    rows = rows.withColumn("drills", drills).withColumn("raw_tokens", words(F.slice("hits", F.lit(1), F.col("drills")), "content"))
    # An unmet turn that lacks the mention alone is met by the first content that has it.
    met = ~expected | F.col("sufficient") | (most > 0) & (F.col("_later") | fits & said)
    base = turns.select("query_id", F.explode("expect.baseline").alias("id")).join(artifacts.select("id", "summary", "content"), "id")
    size = word_count(F.when(F.length("content") > 0, F.col("content")).otherwise(F.col("summary")))
    base = base.groupBy("query_id").agg(F.sum(size).alias("baseline_tokens"))
    rows = rows.join(base, "query_id", "left")
    return rows.select(
        "query_id", met.alias("met"), "sufficient", "drills", "overview_tokens", "raw_tokens", F.coalesce("baseline_tokens", F.lit(0)).alias("baseline_tokens"),
        (F.col("expected_rank") > 0).alias("expected_found"), "expected_rank", "forbid_ok", (expected & (F.size(forbid) > 0)).alias("forbids"),
    )


#: What a scenario must reach at least (the ratio: at most).
SUFFICIENCY, CONTEXT_RATIO, RECALL = 0.8, 0.25, 1.0


def scenario_report(metrics: DataFrame) -> DataFrame:
    """One row over all turns; shares of no turns at all are 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    kept, forbids = F.count_if(F.col("forbids") & F.col("forbid_ok") & F.col("met")), F.count_if("forbids")
    rows = metrics.agg(
        F.count("*").alias("turns"), share(F.count_if("sufficient"), F.count("*")).alias("overview_sufficiency"),
        share(F.sum(F.col("overview_tokens") + F.col("raw_tokens")), F.sum("baseline_tokens")).alias("context_ratio"),
        F.when(forbids == 0, "n/a").when(kept == forbids, "pass").otherwise("fail").alias("constraint_survival"),
        share(F.count_if("expected_found"), F.count("*")).alias("recall"), share(F.sum("expected_rank"), F.count_if("expected_found")).alias("mean_rank"),
    )
    good = (F.col("overview_sufficiency") >= SUFFICIENCY) & (F.col("context_ratio") <= CONTEXT_RATIO) & (F.col("recall") >= RECALL)
    return rows.withColumn("passed", good & (F.col("constraint_survival") != "fail"))
