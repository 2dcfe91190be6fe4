"""From stored tables to an explained Top-N for every profile, in one lazy plan a stage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vector
from ..sources import tables as t
from . import scoring


def profile_tags(spark: SparkSession, sf: str) -> DataFrame:
    """(profile_id, tag, kind, n): normalised topics and negatives with their repeats."""
    p = t.read(spark, sf, "user_explicit_profile")
    plus = p.select("profile_id", F.explode(text.normal_tags(F.col("core_topics"))).alias("tag"), F.lit("topic").alias("kind"))
    minus = p.select("profile_id", F.explode(text.normal_tags(F.col("negative_tags"))).alias("tag"), F.lit("negative").alias("kind"))
    return plus.unionByName(minus).groupBy("profile_id", "tag", "kind").agg(F.count("*").alias("n"))


def item_tags(items: DataFrame) -> DataFrame:
    """(item_id, tag): an item's own tags and the word tokens of its title and content, each once."""
    own = F.array_union(text.normal_tags(F.col("tags")), F.array_union(text.word_tags(F.col("title")), text.word_tags(F.col("content"))))
    return items.select("item_id", F.explode(own).alias("tag"))


def tag_scores(spark: SparkSession, sf: str, items: DataFrame) -> DataFrame:
    """(profile_id, item_id, hits, misses, tag) of the pairs with any match; the profiles' lists are small."""
    both = item_tags(items).join(profile_tags(spark, sf), "tag")
    n = both.groupBy("profile_id", "item_id").agg(F.sum(F.when(F.col("kind") == "topic", F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("kind") == "negative", F.col("n")).otherwise(0)).alias("misses"))
    return n.withColumn("tag", F.when(F.col("misses") > 0, 0.0).otherwise(F.col("hits").cast("double")))


def _topic_sums(sent):
    """For each batch, the sums of unit vectors by profile and dimension: a few rows, whatever the batch."""

    def run(batches):
        topics = sent.value
        for batch in batches:
            vecs, total = batch.column("embedding").to_pylist(), {}
            for tags, v in zip(batch.column("tags").to_pylist(), vecs):
                wanted = set().union(*[topics.get(g, ()) for g in tags or ()])
                if wanted:
                    u = np.asarray(v, dtype=np.float64)
                    u /= np.linalg.norm(u) + 1e-8
                    for p in wanted:
                        s, n = total.get(p, (0.0, 0))
                        total[p] = (s + u, n + 1)
            for p, (s, n) in total.items():
                k = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, p)), pa.array(np.arange(k, dtype=np.int32)), pa.array(s), pa.array(np.full(k, n))], names=["profile_id", "d", "s", "n"])

    return run


def intents(spark: SparkSession, sf: str) -> DataFrame:
    """One vector a profile: the mean of the unit vectors of items that carry one of its topics as a tag."""
    items = t.candidates(spark, sf).where("embedding is not null")
    topics: dict[str, set[int]] = {}
    for row in profile_tags(spark, sf).where("kind = 'topic'").select("profile_id", "tag").collect():  # as small as the profile table
        topics.setdefault(row["tag"], set()).add(row["profile_id"])
    sent = spark.sparkContext.broadcast(topics)
    sums = items.select(text.normal_tags(F.col("tags")).alias("tags"), "embedding").mapInArrow(_topic_sums(sent), "profile_id bigint, d int, s double, n bigint")
    mean = sums.groupBy("profile_id", "d").agg((F.sum("s") / F.sum("n")).alias("x"))
    full = mean.groupBy("profile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("m"))
    return full.select("profile_id", F.lit(0).cast("bigint").alias("pos"), F.lit(1).cast("bigint").alias("size"), vector.unit(F.col("m")).alias("vec"))


def seconds(c) -> F.Column:
    """Epoch seconds, also from milliseconds."""
    return F.when(c > 100_000_000_000, (c / 1000).cast("bigint")).otherwise(c)


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback events of the profiles on stored answers: +1 for a click, -2 for one before its impression."""
    shown = t.read(spark, sf, "inter_impression").distinct().where("click_ts > 0")
    known = t.read(spark, sf, "zhihu_content").where("id is not null").select(text.strip(F.col("id")).alias("answer_id"), "row_id", F.col("metadata")["source"].alias("source"), F.lower(text.strip(F.col("author.id"))).alias("author"))
    first = known.groupBy("answer_id").agg(F.min(F.struct("row_id", "source", "author")).alias("x")).select("answer_id", "x.source", "x.author")
    own = shown.where(F.col("user_id").isin(t.profile_ids(spark, sf)))
    delta = F.when(seconds(F.col("click_ts")) < seconds(F.col("impression_ts")), -2).otherwise(1)
    return own.join(first, "answer_id").select(F.col("user_id").alias("profile_id"), "answer_id", "source", "author", delta.alias("delta"))


def preferences(spark: SparkSession, sf: str) -> DataFrame:
    """(profile_id, kind, key, score): summed signals of sources and authors, and the stated facets."""
    s = signals(spark, sf)
    rows = s.select("profile_id", F.explode(F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")), F.struct(F.lit("author").alias("kind"), F.col("author").alias("key")))).alias("k"), "delta")
    counted = rows.select("profile_id", "k.*", "delta").where("key <> ''").groupBy("profile_id", "kind", "key").agg(F.sum("delta").alias("score"))
    p = t.read(spark, sf, "user_explicit_profile")
    facets = p.select("profile_id", F.lit("facet").alias("kind"), F.explode(F.array_distinct(F.concat(text.normal_tags(F.col("content_depth")), text.normal_tags(F.col("writing_style"))))).alias("key"), F.lit(1).cast("bigint").alias("score"))
    return counted.unionByName(facets)


def component_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(profile_id, item_id, seq, i2i, tag, semantic, popularity, source, facet, quality, explore) of all open pairs."""
    items = t.candidates(spark, sf)
    facts = items.select("item_id", "seq", "embedding", "popularity", F.coalesce("source", F.lit("unknown")).alias("from"), F.lower(F.coalesce(F.col("metadata")["author"], F.lit("unknown"))).alias("by"), F.coalesce(F.col("metadata")["depth"], F.lit("unknown")).alias("depth"), scoring.quality_of(F.col("metadata")["quality"]).alias("quality"))
    pairs = scoring.profile_scores(spark, facts, t.profile_ids(spark, sf), t.cloud(spark, sf), intents(spark, sf))
    pairs = pairs.join(t.saved(spark, sf).select("profile_id", "item_id"), ["profile_id", "item_id"], "left_anti")
    tags = tag_scores(spark, sf, items).select("profile_id", "item_id", "tag")
    prefs = preferences(spark, sf).persist()  # a few rows a profile, looked up three times
    look = lambda kind, key, name: prefs.where(F.col("kind") == kind).select("profile_id", F.col("key").alias(key), F.col("score").cast("double").alias(name))
    pairs = pairs.join(tags, ["profile_id", "item_id"], "left").join(look("source", "from", "s1"), ["profile_id", "from"], "left").join(look("author", "by", "s2"), ["profile_id", "by"], "left").join(look("facet", "depth", "s3"), ["profile_id", "depth"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = pairs.select("profile_id", "item_id", "seq", zero("i2i").alias("i2i"), zero("tag").alias("tag"), zero("semantic").alias("semantic"), "popularity", (zero("s1") + zero("s2")).alias("source"), zero("s3").alias("facet"), "quality")
    return out.withColumn("explore", F.when((F.col("source") == 0) & (F.col("facet") == 0), 1.0).otherwise(0.0))


def recommend(spark: SparkSession, sf: str, preset: str = "balanced", top: int = 20, custom: dict[str, float] | None = None, least: float | None = None) -> DataFrame:
    """The ``top`` items of each profile with their normalised components."""
    weights = scoring.weights_of(preset, custom)
    scored = scoring.fused(component_scores(spark, sf), weights)
    explain = F.map_from_arrays(F.array(*[F.lit(c) for c in weights]), F.array(*[F.round(f"{c}_norm", 6) for c in weights]))
    return scoring.ranked(scored.withColumn("components", explain), top, least).select("profile_id", "rank", "item_id", "final_score", "components")


_PICK = "profile_id bigint, rank bigint, item_id string, final_score double, complete boolean"


def _greedy(top: int, trade: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["final_score", "seq"], ascending=[False, True], kind="stable").reset_index(drop=True)
        score = rows["final_score"].to_numpy()
        vecs = [None if v is None else np.asarray(v, dtype=float) for v in rows["embedding"]]
        some = np.array([v is not None for v in vecs])
        unit = np.zeros((len(rows), next((len(v) for v in vecs if v is not None), 1)))
        for i in np.flatnonzero(some):
            unit[i] = vecs[i] / (np.linalg.norm(vecs[i]) + 1e-8)
        like = np.full(len(rows), -np.inf)
        open_, picked, worst = np.ones(len(rows), dtype=bool), [], np.inf
        while len(picked) < min(top, len(rows)):
            value = trade * score - (1 - trade) * np.where(some & np.isfinite(like), like, 0.0)
            value[~open_] = -np.inf
            k = int(np.argmax(np.round(value, 12)))
            if picked:
                worst = min(worst, value[k])
            picked.append(k)
            open_[k] = False
            if some[k]:
                like = np.maximum(like, unit @ unit[k])
        outside = rows["outside"].iloc[0]
        complete = bool(pd.isna(outside) or worst >= trade * outside + (1 - trade))
        return pd.DataFrame({"profile_id": key[0], "rank": np.arange(1, len(picked) + 1), "item_id": rows["item_id"].iloc[picked].to_numpy(), "final_score": score[picked], "complete": complete})

    return run


def diversified(scored: DataFrame, top: int = 10, trade: float = 0.85, window: int = 4096) -> DataFrame:
    """Maximal marginal relevance: each place goes to the item with the best trade of its score and its
    greatest similarity with those before; the first is the best by score. ``scored`` has (profile_id,
    item_id, seq, final_score, embedding).

    A profile's fold sees its ``window`` best items and knows the best score left outside. No item outside
    can win while every pick beats that score with the least similarity possible; where this fails the
    profile is folded again with a window eight times as large, so the picks are exact."""
    if trade >= 1:
        return scoring.ranked(scored, top).select("profile_id", "rank", "item_id", "final_score")
    by = Window.partitionBy("profile_id").orderBy(F.desc("final_score"), "seq")
    floor = F.max(F.when(F.col("place") == top, F.col("final_score"))).over(Window.partitionBy("profile_id")) - 2 * (1 - trade) / trade
    todo, out = scored, None
    while True:
        placed = todo.withColumn("place", F.row_number().over(by)).where(F.col("place") <= window + 1).withColumn("floor", floor)
        outside = F.max(F.when(F.col("place") == window + 1, F.col("final_score"))).over(Window.partitionBy("profile_id"))
        seen = placed.withColumn("outside", outside).where((F.col("place") <= window) & (F.col("floor").isNull() | (F.col("final_score") >= F.col("floor"))))
        picks = seen.select("profile_id", "item_id", "seq", "final_score", "embedding", "outside").groupBy("profile_id").applyInPandas(_greedy(top, trade), _PICK).persist()
        part = picks.where("complete").drop("complete")
        out = part if out is None else out.unionByName(part)
        unsure = picks.where("not complete").select("profile_id").distinct()
        if not unsure.limit(1).count():
            return out
        todo, window = todo.join(unsure, "profile_id", "left_semi"), window * 8


def with_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """i2i after feedback: near copies of saved items are vetoed, items like those with a negative tag lowered."""
    items = t.candidates(spark, sf).where("embedding is not null")
    cloud = t.cloud(spark, sf)
    bad = tag_scores(spark, sf, t.candidates(spark, sf)).where("misses > 0").select("profile_id", "item_id")
    w = Window.partitionBy("profile_id")
    turned = bad.join(items.select("item_id", "seq", "embedding"), "item_id").withColumn("n", F.row_number().over(w.orderBy("seq")))
    negatives = turned.select("profile_id", (F.col("n") - 1).cast("bigint").alias("pos"), F.count("*").over(w).alias("size"), vector.unit(F.col("embedding")).alias("vec"))
    positive = scoring.cloud_similarity(spark, items, cloud)
    mean3 = scoring.cloud_similarity(spark, items, negatives, top=3, decay=0.0).withColumnRenamed("i2i", "negative")
    copy = scoring.cloud_similarity(spark, items, cloud, top=1).withColumnRenamed("i2i", "duplicate")
    both = t.open_candidates(spark, sf).join(positive, ["profile_id", "item_id"]).join(mean3, ["profile_id", "item_id"], "left").join(copy, ["profile_id", "item_id"], "left")
    low = lambda c: F.coalesce(F.col(c), F.lit(-1.0))
    return both.select("profile_id", "item_id", F.round(scoring.penalised(F.col("i2i"), low("negative"), low("duplicate")), 6).alias("i2i"))
