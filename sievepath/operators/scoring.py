"""Score components of (profile, item), their bounds, normalisation, fusion and ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPONENTS = ("i2i", "tag", "semantic", "popularity", "source", "facet", "quality")
# The weights of the presets.
PRESETS = {
    "balanced": {"i2i": 0.35, "tag": 0.15, "semantic": 0.10, "popularity": 0.10, "source": 0.15, "facet": 0.10, "quality": 0.05},
    "exploration": {"i2i": 0.25, "tag": 0.35, "semantic": 0.20, "popularity": 0.20},
    "precision": {"i2i": 0.60, "tag": 0.15, "semantic": 0.15, "popularity": 0.10},
    "quality": {"i2i": 0.20, "tag": 0.15, "semantic": 0.15, "popularity": 0.50},
}
TOP, DECAY = 3, 0.05
CLOUD_BYTES = 64 << 20


def weights_of(preset: str, custom: dict[str, float] | None = None) -> dict[str, float]:
    """The preset's weights, or the custom ones; both names are checked."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known: {', '.join(PRESETS)}")
    weights = dict(PRESETS[preset] if custom is None else custom)
    known = {*COMPONENTS, "explore", "rerank"}
    if wrong := set(weights) - known:
        raise ValueError(f"unknown components {sorted(wrong)}")
    return weights


def merge_rerank(base: dict[str, float], share: float = 0.5) -> dict[str, float]:
    """The other weights scaled down so that ``rerank`` gets its share."""
    return {k: w * (1 - share) for k, w in base.items() if k != "rerank"} | {"rerank": share}


def cloud_similarity(spark: SparkSession, items: DataFrame, cloud: DataFrame, top: int = TOP, decay: float = DECAY, limit: int = CLOUD_BYTES, metric: str = "cosine") -> DataFrame:
    """(profile_id, item_id, i2i): the mean of the ``top`` greatest similarities (cosine, or one over one plus the
    euclidean distance of the unit vectors, which orders alike) with the profile's vectors,
    weighted by age in places (the last saved item weighs one). ``items`` has (item_id, embedding).

    The clouds are sent to the executors in blocks of at most ``limit`` bytes, each a pass of block
    products over the items, so neither side is shuffled."""
    if top < 1:
        raise ValueError("top must be positive")
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    size = cloud.agg(F.count("*"), F.max(F.size("vec"))).first()
    rows, length = int(size[0]), int(size[1] or 0)
    shape = "profile_id bigint, item_id string, i2i double"
    if not rows:
        return spark.createDataFrame([], shape)
    passes = -(-rows * (8 * length + 32) // limit)
    out = None
    for p in range(passes):
        mine = cloud.where(F.pmod(F.xxhash64("profile_id"), F.lit(passes)) == p).orderBy("profile_id", "pos").toArrow()
        owner = mine.column("profile_id").to_numpy()
        if not len(owner):
            continue
        matrix = np.vstack(mine.column("vec").to_pylist())
        age = np.exp(-decay * (mine.column("size").to_numpy() - 1 - mine.column("pos").to_numpy()))
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        sent = spark.sparkContext.broadcast((owner, matrix, age, cuts))
        part = items.where("embedding is not null").select("item_id", "embedding").mapInArrow(_products(sent, top, metric), shape)
        out = part if out is None else out.unionByName(part)
    return out


def _products(sent, top: int, metric: str):
    def run(batches):
        owner, matrix, age, cuts = sent.value
        for batch in batches:
            for s in range(0, len(batch), 1024):
                b = batch.slice(s, 1024)
                x = np.array(b.column("embedding").to_pylist(), dtype=np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
                sims = x @ matrix.T
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    mine = sims[:, lo:hi]
                    best = np.argsort(-np.round(mine, 12), axis=1, kind="stable")[:, :top]
                    w = age[lo:hi][best]
                    near = np.take_along_axis(mine, best, axis=1)
                    if metric == "euclidean":  # tiny vectors do not reach length one
                        near = 1 / (1 + np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (matrix[lo:hi] ** 2).sum(axis=1)[best] - 2 * near, 0)))
                    score = (near * w).sum(axis=1) / w.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), owner[lo], dtype=np.int64)), b.column("item_id"), pa.array(score)], names=["profile_id", "item_id", "i2i"])

    return run


def profile_scores(spark: SparkSession, items: DataFrame, profiles: list[int], cloud: DataFrame, intents: DataFrame, top: int = TOP, decay: float = DECAY, limit: int = CLOUD_BYTES) -> DataFrame:
    """Every profile with every item: the item's columns (but its embedding) and i2i and semantic scores, 0
    where an item or a profile has no vector. One pass over the items for each block of profiles whose
    vectors fit ``limit``; the item columns are repeated without being copied."""
    keep = [f for f in items.schema.fields if f.name != "embedding"]
    shape = "profile_id bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", i2i double, semantic double"
    sizes = {r[0]: r[1] for r in cloud.groupBy("profile_id").agg(F.sum(8 * F.size("vec") + 32)).collect()}
    blocks: list[list[int]] = [[]]
    room = limit
    for p in profiles:
        need = sizes.get(p, 0) + 1024
        if need > room and blocks[-1]:
            blocks.append([])
            room = limit
        blocks[-1].append(p)
        room -= need
    out = None
    for block in blocks:
        if not block:
            continue
        mine = cloud.where(F.col("profile_id").isin(block)).orderBy("profile_id", "pos").toArrow()
        aims = {r["profile_id"]: np.array(r["vec"]) for r in intents.where(F.col("profile_id").isin(block)).select("profile_id", "vec").collect()}
        owner = mine.column("profile_id").to_numpy()
        matrix = np.vstack(mine.column("vec").to_pylist()) if len(owner) else np.zeros((0, 0))
        age = np.exp(-decay * (mine.column("size").to_numpy() - 1 - mine.column("pos").to_numpy())) if len(owner) else np.zeros(0)
        sent = spark.sparkContext.broadcast((block, owner, matrix, age, aims))
        part = items.mapInArrow(_pairs(sent, [f.name for f in keep], top), shape)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], shape) if out is None else out


def _pairs(sent, keep: list[str], top: int):
    def run(batches):
        profiles, owner, matrix, age, aims = sent.value
        where = {p: np.flatnonzero(owner == p) for p in profiles}
        for batch in batches:
            for s in range(0, len(batch), 2048):
                b = batch.slice(s, 2048)
                vecs = b.column("embedding").to_pylist()
                some = np.array([v is not None for v in vecs], dtype=bool)
                x = np.array([v for v in vecs if v is not None], dtype=np.float64) if some.any() else np.zeros((0, matrix.shape[1]))
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8) if len(x) else x
                sims = x @ matrix.T if len(x) and len(matrix) else np.zeros((len(x), len(matrix)))
                for p in profiles:
                    i2i, meant = np.zeros(len(b)), np.zeros(len(b))
                    at = where[p]
                    if len(at) and len(x):
                        near = sims[:, at]
                        best = np.argsort(-np.round(near, 12), axis=1, kind="stable")[:, :top]
                        w = age[at][best]
                        i2i[some] = (np.take_along_axis(near, best, axis=1) * w).sum(axis=1) / w.sum(axis=1)
                    if p in aims and len(x):
                        meant[some] = np.maximum(0.0, x @ aims[p])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), p, dtype=np.int64)), *[b.column(c) for c in keep], pa.array(i2i), pa.array(meant)], names=["profile_id", *keep, "i2i", "semantic"])

    return run


def penalised(similar: Column, negative: Column, duplicate: Column, gamma: float = 1.5, most: float = 0.5, negative_over: float = 0.8, duplicate_over: float = 0.95) -> Column:
    """-999 beyond the duplicate threshold; minus the capped negative similarity beyond its own."""
    return F.when(duplicate > duplicate_over, F.lit(-999.0)).when(negative > negative_over, similar - F.least(F.lit(gamma) * negative, F.lit(most))).otherwise(similar)


def tag_score(tags: Column, topics: Column, negatives: Column, plus: float = 1.0, minus: float = -2.0, hard: bool = True) -> Column:
    """Matches of the profile's lists in the item's tags, repeats in the lists counted; 0 at a negative match."""
    hits = F.size(F.filter(topics, lambda t: F.array_contains(tags, t))).cast("double")
    misses = F.size(F.filter(negatives, lambda t: F.array_contains(tags, t))).cast("double")
    soft = F.greatest(F.lit(0.0), hits * plus + misses * minus)
    return F.when(misses > 0, F.lit(0.0)).otherwise(soft) if hard else soft


def popularity_of(votes: Column, comments: Column) -> Column:
    return F.log1p(F.coalesce(votes, F.lit(0)).cast("double") + 2 * F.coalesce(comments, F.lit(0)).cast("double"))


def quality_of(raw: Column) -> Column:
    """A fifth of the number, 3 where absent, 0.6 where it is no number."""
    return F.when(raw.isNull(), F.lit(0.6)).otherwise(F.coalesce(raw.try_cast("double") / 5, F.lit(0.6)))


def bounds(scores: DataFrame, components: list[str]) -> DataFrame:
    """Least, greatest and number of present scores of each component a profile."""
    aggs = [f(F.col(c)).alias(f"{c}_{n}") for c in components for n, f in (("min", F.min), ("max", F.max), ("count", F.count))]
    return scores.groupBy("profile_id").agg(*aggs)


def normalised(c: str) -> Column:
    """Min-max by the bounds of those that have the component; missing scores are a raw 0; equal bounds
    give 1 at the bound and 0 elsewhere; fewer than two scores are clipped."""
    raw, low, high = F.coalesce(F.col(c), F.lit(0.0)), F.col(f"{c}_min"), F.col(f"{c}_max")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(F.col(f"{c}_count") < 2, clip(raw)).when(high == low, F.when(raw >= high, 1.0).otherwise(0.0)).otherwise(clip((raw - low) / (high - low)))


def fused(scores: DataFrame, weights: dict[str, float], custom: dict[str, Column] | None = None) -> DataFrame:
    """Adds each weighted component's ``<name>_norm`` and ``final_score``; bounds are one small table a profile."""
    names = [c for c in weights if c in scores.columns]
    scores = scores.persist(StorageLevel.MEMORY_AND_DISK)  # read twice: for the bounds and for the rows
    joined = scores.join(bounds(scores, names), "profile_id")
    for c in names:
        joined = joined.withColumn(f"{c}_norm", normalised(c))
    total = F.lit(0.0)
    for c in names:
        total = total + F.lit(float(weights[c])) * F.col(f"{c}_norm")
    for c in (custom or {}).values():
        total = total + c
    return joined.withColumn("final_score", F.round(total, 6)).drop(*[f"{c}_{n}" for c in names for n in ("min", "max", "count")])


def ranked(scored: DataFrame, top: int | None, least: float | None = None) -> DataFrame:
    """Places by score, then by order of arrival; at most ``top`` a profile."""
    if top is not None and top < 1:
        raise ValueError("top must be positive")
    rows = scored if least is None else scored.where(F.col("final_score") >= least)
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("final_score"), "seq"))
    out = rows.withColumn("rank", place.cast("bigint"))
    return out if top is None else out.where(F.col("rank") <= top)
