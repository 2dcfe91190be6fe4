"""Queries of the ranking pipeline with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recommend as r
from ..operators import scoring
from ..sources import tables as t
from . import base_sql as b

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("candidates_upsert", f"WITH {b.CAND} SELECT item_id, seq, title, source, popularity, embedding IS NOT NULL AS has_vector FROM cand")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t.candidates(spark, sf).select("item_id", "seq", "title", "source", "popularity", F.col("embedding").isNotNull().alias("has_vector"))


@query("dedupe_first", f"WITH {b.SAVED} SELECT profile_id, item_id, seq, title FROM saved")
def _(spark, sf):
    return t.saved(spark, sf).select("profile_id", "item_id", "seq", "title")


@query("anti_join_candidates", f"WITH {b.CAND}, {b.SAVED}, {b.OPEN} SELECT profile_id, count(*) AS n_open, min(seq) AS first_seq FROM open GROUP BY profile_id")
def _(spark, sf):
    return t.open_candidates(spark, sf).groupBy("profile_id").agg(F.count("*").alias("n_open"), F.min("seq").alias("first_seq"))


@query("profile_cloud_weights", f"WITH {b.CAND}, {b.SAVED}, {b.CLOUD} SELECT profile_id, pos, size, round(exp(-0.05::DOUBLE * (size - 1 - pos)), 6) AS weight FROM cloud")
def _(spark, sf):
    return t.cloud(spark, sf).select("profile_id", F.col("pos").cast("bigint").alias("pos"), "size", F.round(F.exp(F.lit(-0.05) * (F.col("size") - 1 - F.col("pos"))), 6).alias("weight"))


@query("i2i_topk_decay", f"WITH {b.CAND}, {b.SAVED}, {b.CLOUD}, {b.near('near3', 'cloud', 3, 0.05)} SELECT profile_id, item_id, round(score, 6) AS i2i FROM near3")
def _(spark, sf):
    return scoring.cloud_similarity(spark, t.candidates(spark, sf), t.cloud(spark, sf)).withColumn("i2i", F.round("i2i", 6))


@query("vector_nearest_mean", f"WITH {b.CAND}, {b.SAVED}, {b.CLOUD}, {b.near('near5', 'cloud', 5, 0.0)} SELECT profile_id, item_id, round(score, 6) AS mean_sim FROM near5")
def _(spark, sf):
    out = scoring.cloud_similarity(spark, t.candidates(spark, sf), t.cloud(spark, sf), top=5, decay=0.0)
    return out.select("profile_id", "item_id", F.round("i2i", 6).alias("mean_sim"))


@query("tag_match", f"WITH {b.CAND}, {b.PTAGS} SELECT profile_id, item_id, hits::BIGINT AS hits, misses::BIGINT AS misses, CASE WHEN misses > 0 THEN 0.0 ELSE hits END::DOUBLE AS tag FROM tagged")
def _(spark, sf):
    return r.tag_scores(spark, sf, t.candidates(spark, sf)).select("profile_id", "item_id", "hits", "misses", "tag")


@query("semantic_intent", f"WITH {b.CAND}, {b.SAVED}, {b.CLOUD}, {b.PTAGS}, {b.INTENT}, {b.near('meant', 'intent', 1, 0.05)} SELECT profile_id, item_id, round(greatest(0, score), 6) AS semantic FROM meant")
def _(spark, sf):
    return scoring.cloud_similarity(spark, t.candidates(spark, sf), r.intents(spark, sf), top=1).select("profile_id", "item_id", F.round(F.greatest(F.lit(0.0), F.col("i2i")), 6).alias("semantic"))


@query("feedback_prefs", f"WITH {b.PREFS} SELECT * FROM prefs")
def _(spark, sf):
    return r.preferences(spark, sf)


@query("feedback_signals", f"WITH {b.PREFS} SELECT profile_id, count(*) AS n_signals, count(DISTINCT answer_id) AS n_items, sum(delta)::BIGINT AS total FROM signals GROUP BY profile_id")
def _(spark, sf):
    return r.signals(spark, sf).groupBy("profile_id").agg(F.count("*").alias("n_signals"), F.countDistinct("answer_id").alias("n_items"), F.sum("delta").alias("total"))


_PENALTY = f"""WITH {b.CAND}, {b.SAVED}, {b.CLOUD}, {b.OPEN}, {b.PTAGS}, {b.near('near3', 'cloud', 3, 0.05)}, {b.near('copy', 'cloud', 1, 0.05)},
turned AS (SELECT g.profile_id, row_number() OVER (PARTITION BY g.profile_id ORDER BY x.seq) AS n, x.u FROM tagged g JOIN units x USING (item_id) WHERE g.misses > 0),
neg AS (SELECT profile_id, n - 1 AS pos, 0 AS size, u AS vec FROM turned), {b.near('neg3', 'neg', 3, 0.0)}
SELECT o.profile_id, o.item_id, round(CASE WHEN coalesce(d.score, -1) > 0.95 THEN -999.0 WHEN coalesce(m.score, -1) > 0.8 THEN p.score - least(1.5 * m.score, 0.5) ELSE p.score END, 6)::DOUBLE AS i2i
FROM open o JOIN near3 p ON p.profile_id = o.profile_id AND p.item_id = o.item_id LEFT JOIN neg3 m ON m.profile_id = o.profile_id AND m.item_id = o.item_id LEFT JOIN copy d ON d.profile_id = o.profile_id AND d.item_id = o.item_id"""


@query("feedback_penalty", _PENALTY)
def _(spark, sf):
    return r.with_penalty(spark, sf)


@query("component_bounds", f"WITH {b.ALL} SELECT profile_id, {', '.join(f'round(min({c}), 6)::DOUBLE AS {c}_min, round(max({c}), 6)::DOUBLE AS {c}_max, count({c}) AS {c}_count' for c in scoring.COMPONENTS)} FROM scores GROUP BY profile_id")
def _(spark, sf):
    out = scoring.bounds(r.component_scores(spark, sf), list(scoring.COMPONENTS))
    return out.select("profile_id", *[x for c in scoring.COMPONENTS for x in (F.round(f"{c}_min", 6).alias(f"{c}_min"), F.round(f"{c}_max", 6).alias(f"{c}_max"), f"{c}_count")])


@query("component_scores", f"WITH {b.ALL} SELECT profile_id, item_id, round(source, 6) AS source, round(facet, 6) AS facet, round(quality, 6) AS quality, round(popularity, 6) AS popularity, CASE WHEN source = 0 AND facet = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS explore FROM scores")
def _(spark, sf):
    return r.component_scores(spark, sf).select("profile_id", "item_id", *[F.round(c, 6).alias(c) for c in ("source", "facet", "quality", "popularity")], "explore")


def _preset(preset: str) -> None:
    weights = scoring.PRESETS[preset]
    parts = "map {" + ", ".join(f"'{c}': {c}_norm::DOUBLE" for c in weights) + "}"
    sql = f"WITH {b.fused(weights)} SELECT profile_id, rank, item_id, final_score, {parts} AS components FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY final_score DESC, seq) AS rank FROM fused) WHERE rank <= 20"

    @query(f"recommend_{preset}", sql)
    def _(spark, sf):
        return r.recommend(spark, sf, preset)


for _name in scoring.PRESETS:
    _preset(_name)

_FUSED = f"WITH {b.fused(scoring.PRESETS['balanced'])}"


@query("min_score_filter", f"{_FUSED} SELECT profile_id, count(*) AS n FROM fused WHERE final_score >= 0.35 GROUP BY profile_id")
def _(spark, sf):
    scored = scoring.fused(r.component_scores(spark, sf), scoring.PRESETS["balanced"])
    return scoring.ranked(scored, None, least=0.35).groupBy("profile_id").agg(F.count("*").alias("n"))


@query("filter_count", f"WITH {b.ALL} SELECT profile_id, count(*) FILTER (WHERE coalesce(tag, 0) = 0) AS n_filtered, count(*) AS n_items FROM scores GROUP BY profile_id")
def _(spark, sf):
    return r.component_scores(spark, sf).groupBy("profile_id").agg(F.count_if(F.coalesce("tag", F.lit(0.0)) == 0).alias("n_filtered"), F.count("*").alias("n_items"))


_MERGED = {c: w * 0.5 for c, w in scoring.PRESETS["balanced"].items()}
_RERANK = f"""{_FUSED}, window_ AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY final_score DESC, seq) AS place FROM fused),
judged AS (SELECT profile_id, item_id, least(10, length(title)) / 10.0 AS rerank FROM window_ JOIN cand USING (item_id) WHERE place <= 50),
s2 AS (SELECT s.*, j.rerank FROM scores s LEFT JOIN judged j ON j.profile_id = s.profile_id AND j.item_id = s.item_id),
b2 AS (SELECT profile_id, {b.bounds([*_MERGED, 'rerank'])} FROM s2 GROUP BY profile_id),
f2 AS (SELECT s.profile_id, s.item_id, s.seq, round({' + '.join(f'{w}::DOUBLE * ({b.norm(c)})' for c, w in {**_MERGED, 'rerank': 0.5}.items())}, 6) AS final_score FROM s2 s JOIN b2 b USING (profile_id))
SELECT profile_id, rank, item_id, final_score FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY final_score DESC, seq) AS rank FROM f2) WHERE rank <= 20"""


@query("rerank_merge", _RERANK)
def _(spark, sf):
    """The first fifty of the coarse order get an outside judgement (here the title's length, at most 10)."""
    scores = r.component_scores(spark, sf)
    coarse = scoring.ranked(scoring.fused(scores, scoring.PRESETS["balanced"]), 50).select("profile_id", "item_id")
    judged = coarse.join(t.candidates(spark, sf).select("item_id", (F.least(F.lit(10), F.length("title")) / 10.0).alias("rerank")), "item_id")
    weights = scoring.merge_rerank(scoring.PRESETS["balanced"])
    return scoring.ranked(scoring.fused(scores.join(judged, ["profile_id", "item_id"], "left"), weights), 20).select("profile_id", "rank", "item_id", "final_score")


@query("mmr_top10")
def _(spark, sf):
    scored = scoring.fused(r.component_scores(spark, sf), scoring.PRESETS["balanced"]).select("profile_id", "item_id", "seq", "final_score")
    return r.diversified(scored.join(t.candidates(spark, sf).select("item_id", "embedding"), "item_id"))
