"""Offline evaluation: splits, histories, ranking metrics, comparisons and ratings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clicks(shown: DataFrame) -> DataFrame:
    """(user_id, item, shown_at, clicked_at) of clicks not before their impression, each once, in seconds."""
    sec = lambda c: F.when(F.col(c) > 100_000_000_000, (F.col(c) / 1000).cast("bigint")).otherwise(F.col(c))
    rows = shown.distinct().where("click_ts > 0 and impression_ts is not null and answer_id is not null")
    return rows.select("user_id", F.col("answer_id").alias("item"), sec("impression_ts").alias("shown_at"), sec("click_ts").alias("clicked_at")).where("clicked_at >= shown_at").distinct()


def split_times(clicked: DataFrame, train: float = 0.8, valid: float = 0.1) -> tuple[int, int]:
    """The click times at which training and validation end: exact quantiles of a histogram by time, so no
    global sort of single clicks is needed."""
    by = clicked.groupBy("clicked_at").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n")).first()[0] or 0
    day = by.groupBy((F.col("clicked_at") / 86400).cast("bigint").alias("day")).agg(F.sum("n").alias("n")).orderBy("day").collect()
    out = []
    for share in (train, train + valid):
        goal, seen, hit = math.floor(total * share), 0, None
        for d in day:
            if seen + d["n"] > goal:
                hit = d["day"]
                break
            seen += d["n"]
        if hit is None:
            out.append(1 << 62)
            continue
        for r in by.where((F.col("clicked_at") / 86400).cast("bigint") == hit).orderBy("clicked_at").toLocalIterator():
            if seen + r["n"] > goal:
                out.append(r["clicked_at"])
                break
            seen += r["n"]
    return out[0], out[1]


def split(clicked: DataFrame, ends: tuple[int, int]) -> DataFrame:
    """Adds ``part``: clicks of one second are never parted."""
    return clicked.withColumn("part", F.when(F.col("clicked_at") < ends[0], "train").when(F.col("clicked_at") < ends[1], "valid").otherwise("test"))


def histories(clicked: DataFrame, last: int = 20) -> DataFrame:
    """Each click with the up to ``last`` items its user clicked before, oldest first. A window sees one day of one
    user; what earlier days leave, at most ``last`` items a day, is carried over, so no user is one task."""
    rows = clicked.withColumn("_day", F.floor(F.col("clicked_at") / 86400))
    order = ["clicked_at", "shown_at", "item"]
    day = Window.partitionBy("user_id", "_day")
    from_end = F.row_number().over(day.orderBy(*[F.desc(c) for c in order]))
    tail = rows.withColumn("_n", from_end).where(F.col("_n") <= last).groupBy("user_id", "_day").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_tail"))
    before = Window.partitionBy("user_id").orderBy("_day").rowsBetween(-last, -1)  # each day has one click at least
    left = F.flatten(F.collect_list(F.transform("_tail", lambda x: x["item"])).over(before))
    carried = tail.select("user_id", "_day", left.alias("_carried"))
    seen = rows.withColumn("_seen", F.collect_list("item").over(day.orderBy(*order).rowsBetween(-last, -1))).join(carried, ["user_id", "_day"])
    whole = F.concat("_carried", "_seen")
    return seen.withColumn("history", F.slice(whole, F.greatest(F.size(whole) - last + 1, F.lit(1)), F.lit(last))).drop("_day", "_seen", "_carried")


def hard_negatives(shown: DataFrame, clicked: DataFrame, window: int = 600) -> DataFrame:
    """Per click, how many other items its user saw within ``window`` seconds around its impression and never
    clicked. Joined on (user, time bucket), so a user's impressions never meet all of its clicks."""
    sec = F.when(F.col("impression_ts") > 100_000_000_000, (F.col("impression_ts") / 1000).cast("bigint")).otherwise(F.col("impression_ts"))
    seen = shown.where("impression_ts is not null and answer_id is not null").select("user_id", F.col("answer_id").alias("other"), sec.alias("at")).distinct()
    never = seen.join(clicked.select("user_id", F.col("item").alias("other")).distinct(), ["user_id", "other"], "left_anti")
    bucket = (F.col("at") / window).cast("bigint")
    near = never.withColumn("bucket", bucket)
    asked = clicked.withColumn("bucket", F.explode(F.array(*[(F.col("shown_at") / window).cast("bigint") + d for d in (-1, 0, 1)])))
    hits = asked.join(near, ["user_id", "bucket"]).where(F.abs(F.col("at") - F.col("shown_at")) <= window)
    found = hits.groupBy("user_id", "item", "shown_at", "clicked_at").agg(F.countDistinct("other").alias("n_negatives"))
    return found


def popularity(clicked: DataFrame) -> DataFrame:
    return clicked.groupBy("item").agg(F.count("*").alias("n"))


def popular_recall(parts: DataFrame, ks: tuple[int, ...] = (10, 50)) -> DataFrame:
    """Recall and NDCG of the most clicked training items for each later click, and the mean reciprocal rank."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "item"))
    top = popularity(parts.where("part = 'train'")).orderBy(F.desc("n"), "item").limit(max(ks)).withColumn("rank", rank).select("item", "rank")
    asked = parts.where("part <> 'train'").join(F.broadcast(top), "item", "left")
    aggs = [F.count("*").alias("n_clicks")]
    for k in ks:
        hit = F.col("rank") <= k
        aggs += [F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}"), F.round(F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}")]
    aggs.append(F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
    return asked.groupBy("part").agg(*aggs)


def masked_popularity(parts: DataFrame) -> DataFrame:
    """Hits and reciprocal rank of the popular list when each user's own training clicks are taken out of it. The
    masked rank of a target is its rank less the clicked items above it; a target clicked before keeps its place.
    Clicked items are counted by blocks of 1024 ranks, so no user's list is gathered whole."""
    train = parts.where("part = 'train'")
    pop = _ranked(popularity(train))
    bucket = lambda c: F.floor(F.col(c) / 1024)
    seen = train.select("user_id", "item").distinct().join(pop, "item").select("user_id", F.col("rank").alias("seen_rank"), bucket("rank").alias("b"))
    asked = parts.where("part <> 'train'").join(pop, "item", "left").select("part", "user_id", "rank", bucket("rank").alias("b"))
    near = seen.groupBy("user_id", "b").agg(F.sort_array(F.collect_list("seen_rank")).alias("own"))  # at most 1024, a bucket has no more ranks
    sizes = near.select("user_id", "b", F.size("own").alias("n")).unionByName(asked.where("b is not null").select("user_id", "b", F.lit(0).alias("n")).distinct()).groupBy("user_id", "b").agg(F.sum("n").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("user_id", "b", "before")
    asked = asked.join(near, ["user_id", "b"], "left").join(before, ["user_id", "b"], "left")
    above = F.when(F.col("own").isNotNull(), F.size(F.filter("own", lambda r: r < F.col("rank")))).otherwise(0)
    rank = F.col("rank") - above - F.coalesce("before", F.lit(0))
    rows = asked.select("part", rank.alias("rank"))
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("part").agg(F.count("*").alias("n_clicks"), hit(10).alias("hit_10"), hit(50).alias("recall_50"), hit(100).alias("recall_100"), F.round(F.avg(F.when(F.col("rank") <= 50, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_50"))


def _ranked(counts: DataFrame) -> DataFrame:
    """(item, rank) by count, then item, without one window over all: places inside a count, behind those of higher
    counts. Different counts are few."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))).select("n", F.coalesce("before", F.lit(0)).alias("before"))
    inside = counts.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy("item")))
    return inside.join(before, "n").select("item", (F.col("place") + F.col("before")).alias("rank"))


def mean_pool_ranks(train: DataFrame, asked: DataFrame, vectors: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``train``: (user_id, item), ``asked``: (ask_id, user_id, item), ``vectors``: (item, vec) of unit length. Adds the
    rank of the asked item among all items by cosine with the mean of the user's vectors: one pass of block products
    over the items for each block of at most ``limit`` bytes of questions; only counts are shuffled."""
    spark = train.sparkSession
    each = train.join(vectors, "item").select("user_id", F.posexplode("vec").alias("d", "x"))
    pooled = each.groupBy("user_id", "d").agg(F.avg("x").alias("x")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("m"))
    means = pooled.select("user_id", F.transform("m", lambda r: r["x"]).alias("mean"))
    known = asked.join(means, "user_id").join(vectors, "item").select("ask_id", "mean", "vec").persist()
    n, width = known.agg(F.count("*"), F.max(F.size("mean"))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // limit))
    out = None
    for k in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("ask_id"), F.lit(blocks)) == k).toArrow()
        if not mine.num_rows:
            continue
        users, target = np.array(mine.column("mean").to_pylist()), np.array(mine.column("vec").to_pylist())
        sent = spark.sparkContext.broadcast((mine.column("ask_id").to_numpy(), users, np.einsum("ij,ij->i", users, target)))
        part = vectors.select("vec").mapInArrow(_above(sent), "ask_id bigint, n bigint")
        out = part if out is None else out.unionByName(part)
    known.unpersist()
    if out is None:
        return spark.createDataFrame([], "ask_id bigint, rank bigint")
    return out.groupBy("ask_id").agg((F.sum("n") + 1).alias("rank"))


def _above(sent):
    def run(batches):
        ids, users, least = sent.value
        n = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist())
            for a in range(0, len(ids), 4096):
                n[a : a + 4096] += (x @ users[a : a + 4096].T > least[a : a + 4096] + 1e-9).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["ask_id", "n"])

    return run


def list_metrics(samples: DataFrame, k: int) -> DataFrame:
    """``samples``: (target, ranked array). Mean recall and NDCG at ``k``."""
    place = F.array_position(F.slice("ranked", 1, k), F.col("target"))
    return samples.agg(F.avg(F.when(place > 0, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(place > 0, 1 / F.log2(place + 1)).otherwise(0.0)).alias("ndcg"), F.count("*").alias("n"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ranked lists a profile: shared items, Jaccard, mean rank gap of the shared, same first."""
    left = a.select("profile_id", "item_id", F.col("rank").alias("ra"))
    right = b.select("profile_id", "item_id", F.col("rank").alias("rb"))
    both = left.join(right, ["profile_id", "item_id"], "full")
    shared = F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull())
    return both.groupBy("profile_id").agg(
        shared.alias("n_shared"), F.round(shared / F.count("*"), 6).alias("jaccard"), F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 6).alias("rank_gap"), F.max(F.coalesce((F.col("ra") == 1) & (F.col("rb") == 1), F.lit(False))).alias("same_first")
    )


def win_report(games: DataFrame) -> DataFrame:
    """``games``: (left_side, right_side, winner A|B|tie). Wins of either side; the rate leaves ties out."""
    a, b_, tie = (F.count_if(F.col("winner") == w) for w in ("A", "B", "tie"))
    return games.groupBy("left_side", "right_side").agg(a.alias("left_wins"), b_.alias("right_wins"), tie.alias("ties"), F.round(F.when(a + b_ > 0, b_ / (a + b_)), 6).alias("right_rate"))


def order_flips(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs judged in both orders: unstable where the verdicts differ."""
    both = forward.select("pair_id", F.col("winner").alias("w1")).join(backward.select("pair_id", F.col("winner").alias("w2")), "pair_id")
    return both.select("pair_id", F.when(F.col("w1") == F.col("w2"), F.col("w1")).otherwise("unstable").alias("verdict"))


def rank_stability(trials: DataFrame) -> DataFrame:
    """``trials``: (item_id, trial, rank). Population deviation of each item's ranks and its range."""
    return trials.groupBy("item_id").agg(F.count("*").alias("n_trials"), F.round(F.stddev_pop("rank"), 6).alias("rank_std"), F.min("rank").alias("best"), F.max("rank").alias("worst"))


def chosen_winner(runs: DataFrame, error_tolerance: float = 0.01) -> DataFrame:
    """Complete runs only: those within the tolerance of the least error rate, then least flips, then least time."""
    done = runs.where("pairs_done = pairs_total")
    least = done.agg(F.min("error_rate").alias("least"))
    return done.join(F.broadcast(least), F.col("error_rate") <= F.col("least") + error_tolerance).orderBy("flip_rate", "seconds", "run").limit(1).drop("least")


SCALE, START, SPREAD, VOLATILITY, TAU = 173.7178, 1500.0, 350.0, 0.06, 0.5


def _glicko_step(mu: float, phi: float, sigma: float, games: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """One rating period of the published Glicko-2 algorithm; ``games`` holds (mu_j, phi_j, score). The equation of the
    volatility has several roots where a game was all but certain; the one next to the old volatility counts, as any
    other has one upset blow it up. Nobody's deviation exceeds a new player's, as in Glicko, nor does
    the volatility, since with one game a period they else feed each other without bound. Certain games are kept apart from 0 and 1 in floating point."""
    gain = weight = 0.0
    for m, p, s in games:
        g = 1 / math.sqrt(1 + 3 * p * p / math.pi**2)
        x = g * (mu - m)
        z = math.exp(-abs(x))
        e = 1 / (1 + z) if x >= 0 else z / (1 + z)
        gain += g * (s - e)
        weight += g * g * max(z / (1 + z) ** 2, 1e-290)
    v = 1 / weight
    push, a = gain * gain * v, math.log(sigma * sigma)  # delta**2 is push * v

    def f(x: float) -> float:
        ex = math.exp(x)
        q = phi * phi + v + ex
        return ex / (2 * q) * (push * (v / q) - 1) - (x - a) / TAU**2

    low, k = a, 1
    if push * v > phi * phi + v + sigma * sigma:
        while f(a + k * TAU) > 0:
            k += 1
        low, high = a + (k - 1) * TAU, a + k * TAU
    elif push * v > phi * phi + v:
        high = math.log(push * v - phi * phi - v)
    else:
        while f(a - k * TAU) < 0:
            k += 1
        high = a - k * TAU
    fl, fh = f(low), f(high)
    while abs(high - low) > 1e-6:
        mid = low + (low - high) * fl / (fh - fl)
        fm = f(mid)
        if fm * fh <= 0:
            low, fl = high, fh
        else:
            fl /= 2
        high, fh = mid, fm
    sigma = min(math.exp(low / 2), SPREAD / SCALE)
    wide = math.sqrt(phi * phi + sigma * sigma)
    phi = min(1 / math.sqrt(1 / (wide * wide) + 1 / v), SPREAD / SCALE)
    return mu + phi * phi * gain, phi, sigma


def glicko(games: DataFrame) -> DataFrame:
    """``games``: (arena, at, a, b, score of a: 1, 0.5 or 0). Sequential ratings, one game a period, by arena; games of
    the same players at the same time go by a column ``game``, if there is one, and by score. Spark sorts, on disk where need be; the fold reads its arena's games in
    batches and holds the players alone."""
    schema = "arena string, player string, rating double, deviation double, n_games bigint"

    def rated(arena, state: dict) -> pa.RecordBatch:
        rows = [(arena, p, START + SCALE * m, SCALE * d, n) for p, (m, d, _, n) in sorted(state.items())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], names=["arena", "player", "rating", "deviation", "n_games"])

    def fold(batches):
        new = (0.0, SPREAD / SCALE, VOLATILITY, 0)
        last, state = None, {}
        for batch in batches:
            for arena, a, b_, s in zip(*(batch.column(c).to_pylist() for c in ("arena", "a", "b", "score"))):
                if arena != last:
                    if state:
                        yield rated(last, state)
                    last, state = arena, {}
                x, y = state.get(a, new), state.get(b_, new)
                state[a] = (*_glicko_step(*x[:3], [(y[0], y[1], s)]), x[3] + 1)
                state[b_] = (*_glicko_step(*y[:3], [(x[0], x[1], 1 - s)]), y[3] + 1)
        if state:
            yield rated(last, state)

    order = [c for c in ("at", "a", "b", "game", "score") if c in games.columns]
    rows = games.select(*[F.col(c).cast("string").alias(c) for c in ("arena", "a", "b")], *[c for c in order if c not in ("a", "b", "score")], F.col("score").cast("double").alias("score"))
    return rows.repartition("arena").sortWithinPartitions("arena", *map(F.asc_nulls_last, order)).select("arena", "a", "b", "score").mapInArrow(fold, schema)


def mock_vectors(df: DataFrame, id_: str, body: str, length: int = 64) -> DataFrame:
    """A unit vector for each text, drawn from a generator seeded by the text's digest."""
    import hashlib

    def run(batches):
        for pdf in batches:
            out = []
            for s in pdf[body].fillna(""):
                seed = int(hashlib.md5(s.encode()).hexdigest(), 16) % (1 << 32)
                v = np.random.RandomState(seed).randn(length)
                out.append((v / np.linalg.norm(v)).tolist())
            yield pd.DataFrame({id_: pdf[id_], "vec": out})

    return df.select(id_, body).mapInPandas(run, f"{id_} {df.schema[id_].dataType.simpleString()}, vec array<double>")


def clusters(vectors: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """k-means over (id, vec): id, cluster. ``k`` is at most the number of vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    n = ready.limit(k).count()
    if n < 2:
        return vectors.select("id", F.lit(0).alias("cluster"))
    return KMeans(k=n, seed=seed, maxIter=20).fit(ready).transform(ready).select("id", F.col("prediction").alias("cluster"))
