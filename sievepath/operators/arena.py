"""Comparing two systems: blind unions, matchups, choices, decisions, rating summaries, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blind_union(a: DataFrame, b: DataFrame, item: str, seed: str) -> DataFrame:
    """Every item of either list once, in an order that tells nothing of its system but is the same in every run."""
    both = a.select(item).unionByName(b.select(item)).distinct()
    shuffled = F.md5(F.concat(F.col(item).cast("string"), F.lit(seed)))
    return both.withColumn("key", shuffled)


def matchups(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """Every item of system A against every one of system B inside a group; the lists are top-k, so a group has k² rows."""
    left = a.select(group, F.col(item).alias("a_item"), F.col("rank").alias("a_rank"))
    return left.join(b.select(group, F.col(item).alias("b_item"), F.col("rank").alias("b_rank")), group)


def rank_aligned(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """Only the items of equal rank meet."""
    return matchups(a, b, group, item).where("a_rank = b_rank")


def choice(raw: Column, a_item: Column, b_item: Column) -> Column:
    """A, B or tie of what a judge said: a letter, an item's id, or a word for neither; null if unreadable."""
    said = F.lower(F.trim(raw))
    return F.when(said.isin("a", "left", "1") | (said == F.lower(a_item)), "A").when(said.isin("b", "right", "2") | (said == F.lower(b_item)), "B").when(said.isin("tie", "draw", "equal", "neither", "both", "平局", "0"), "tie")


def decisions(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A pair decided twice counts once, by its latest decision."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending(pairs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs that a resumed run still has to ask for."""
    return pairs.join(done.select(*keys).distinct(), keys, "left_anti")


def wins(decided: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Wins of each system and the share of B, ties aside."""
    a, b, tie = (F.count_if(F.col("winner") == w) for w in ("A", "B", "tie"))
    return decided.groupBy(*(group or [])).agg(F.count("*").alias("n"), a.alias("a_wins"), b.alias("b_wins"), tie.alias("ties"), F.round(F.when(a + b > 0, b / (a + b)), 6).alias("b_rate"))


def rating_summary(ratings: DataFrame, system: str, rating: str, top: int = 3) -> DataFrame:
    """(system, n, mean, top mean, median) of ratings; null ratings are left out."""
    rows = ratings.where(F.col(rating).isNotNull())
    place = F.row_number().over(Window.partitionBy(system).orderBy(F.desc(rating)))
    best = rows.withColumn("_p", place).where(F.col("_p") <= top).groupBy(system).agg(F.round(F.avg(rating), 6).alias("top_mean"))
    whole = rows.groupBy(system).agg(F.count("*").alias("n"), F.round(F.avg(rating), 6).alias("mean"), F.round(F.percentile(rating, F.lit(0.5)), 6).alias("median"))
    return whole.join(best, system)


def instability(order_flip_rate: Column, rerank_variance: Column, flip: float = 0.3, variance: float = 0.3) -> Column:
    """What unstable orders come from: the judge's order bias, the reranker, or neither alone."""
    judge, ranker = order_flip_rate >= flip, rerank_variance >= variance
    return F.when(judge & ~ranker, "judge_order_bias").when(ranker & ~judge, "reranker_variance").otherwise("balanced_or_low_signal")


def swiss_pairs(ratings: DataFrame, played: DataFrame, bucket: float = 50.0, most_repeats: int = 1) -> DataFrame:
    """One round: the most uncertain player of each rating bucket and the next meet, if they have not met too often.
    ``ratings``: (arena, player, rating, rd), ``played``: (arena, a, b). Pairs only form inside a bucket."""
    w = Window.partitionBy("arena", "bucket").orderBy(F.desc("rd"), "player")
    placed = ratings.withColumn("bucket", F.floor(F.col("rating") / bucket)).withColumn("n", F.row_number().over(w) - 1)
    side = lambda k, name: placed.where(F.col("n") % 2 == k).select("arena", "bucket", F.floor(F.col("n") / 2).alias("table"), F.col("player").alias(name))
    met = played.select("arena", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).groupBy("arena", "lo", "hi").agg(F.count("*").alias("times"))
    pairs = side(0, "a").join(side(1, "b"), ["arena", "bucket", "table"]).select("arena", "a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return pairs.join(met, ["arena", "lo", "hi"], "left").where(F.coalesce("times", F.lit(0)) < most_repeats).select("arena", "a", "b")
