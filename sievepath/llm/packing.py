"""Documents into containers of fixed capacity by sum-of-squares packing.

Documents are dealt to shards of bounded size by hash. Inside a shard they are placed in
decreasing size, each where the sum over gaps of (open containers with that gap) squared
becomes least; ties take the smaller gap left. A document over the capacity fills whole
containers, and only its last piece is placed. Contents of containers that stay too loose
are dealt to fewer shards and packed again, so what shards leave over is combined.

Defined cases: null and empty texts have no tokens and lie in some container at no cost; each
row is packed for itself, repeated ids included; kinds with a null or non-positive capacity
are left out; an empty table gives an empty assignment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch
from ._tokens import VOCABULARY, with_counts

SHARD = 8192
LOOSE = 0.01
KINDS = 1000
_SHAPE = "container_kind string, capacity bigint, doc_id bigint, row_no bigint, piece_no int, start_token bigint, n_tokens bigint, container_id string, gap bigint"


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each size (all at most ``capacity``), and the gap each container keeps."""
    open_ = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; full ones are not counted
    by_gap: dict[int, list[int]] = {}
    gaps: list[int] = []
    where = np.zeros(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        s = int(sizes[i])
        if s == 0:
            if not gaps:
                gaps.append(capacity)
                open_[capacity] += 1
                by_gap.setdefault(capacity, []).append(0)
            where[i] = 0
            continue
        fits = np.flatnonzero(open_[s:])
        new_left = capacity - s
        best, left = 2 * open_[new_left] + 1 if new_left else 0, -1
        if len(fits):
            change = 2 * open_[fits] - 2 * open_[fits + s] + 2
            if fits[0] == 0:
                change[0] = 1 - 2 * open_[s]
            k = int(np.argmin(change))
            if change[k] <= best:
                left = int(fits[k])
        if left >= 0:
            gap = left + s
            c = by_gap[gap].pop()
            open_[gap] -= 1
        else:
            left, c = new_left, len(gaps)
            gaps.append(0)
        gaps[c] = left
        if left:
            open_[left] += 1
            by_gap.setdefault(left, []).append(c)
        where[i] = c
    return where, np.array(gaps, dtype=np.int64)


def _pack(level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, shard = key
        capacity = int(rows["capacity"].iloc[0])
        rows = rows.sort_values(["n_tokens", "row_no"], ascending=[False, True], kind="stable")
        where, gaps = place(rows["n_tokens"].to_numpy(), capacity)
        return rows.drop(columns="shard").assign(container_id=[f"{level}-{shard}-{c}" for c in where.tolist()], gap=gaps[where] if len(rows) else 0)

    return run


def pack(spark: SparkSession, documents: DataFrame, containers: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """(container_kind, doc_id, piece_no, start_token, n_tokens, container_id) of every document and kind."""
    store = Scratch(spark, "packing")
    counted = with_counts(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")), "text", vocabulary)
    sizes = store.write(counted.withColumn("row_no", F.monotonically_increasing_id()), "sizes")  # fixed once written, tells repeated ids apart
    kinds = [(r[0], int(r[1])) for r in containers.select("container_kind", "capacity_tokens").distinct().limit(KINDS + 1).collect() if r[1] is not None and r[1] > 0]
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    if not kinds:
        return spark.createDataFrame([], _SHAPE).drop("capacity", "gap", "row_no")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in kinds]))
    rows = sizes.select("doc_id", "row_no", "n_tokens", each.alias("k")).select("doc_id", "row_no", F.col("n_tokens").alias("all"), "k.*")
    last = F.greatest(F.ceil(F.col("all") / F.col("capacity")).cast("int") - 1, F.lit(0))
    piece = F.explode(F.sequence(F.lit(0), last)).alias("piece_no")
    pieces = rows.select("container_kind", "capacity", "doc_id", "row_no", "all", piece).withColumn("start_token", F.col("piece_no") * F.col("capacity"))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("capacity"), F.col("all") - F.col("start_token"))).select("container_kind", "capacity", "doc_id", "row_no", "piece_no", "start_token", "n_tokens")
    whole = pieces.where("n_tokens = capacity").withColumn("container_id", F.concat_ws("-", F.lit("w"), F.col("row_no"), F.col("piece_no"))).withColumn("gap", F.lit(0).cast("bigint"))
    done, todo, level, left = whole, pieces.where("n_tokens < capacity"), 0, sizes.count()
    while True:
        shards = max(1, -(-left // shard))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("row_no", F.lit(level)), F.lit(shards)).cast("int"))
        packed = store.write(dealt.groupBy("container_kind", "shard").applyInPandas(_pack(level), _SHAPE), f"level{level}")
        loose = packed.where(F.col("gap") > F.col("capacity") * LOOSE)
        n = loose.count() if shards > 1 else 0
        again = -(-n // (shard * len(kinds)))
        if shards == 1 or n == 0 or again >= shards:
            done = done.unionByName(packed)
            break
        done = done.unionByName(packed.where(F.col("gap") <= F.col("capacity") * LOOSE))
        todo, left, level = loose.drop("container_id", "gap"), -(-n // len(kinds)), level + 1
    return done.select("container_kind", "doc_id", "piece_no", "start_token", "n_tokens", "container_id")


def fill(assignment: DataFrame, containers: DataFrame) -> DataFrame:
    """How full the containers of each kind are."""
    each = assignment.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"))
    kinds = containers.select("container_kind", "capacity_tokens").distinct()
    return each.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("used").alias("used_tokens")).join(kinds, "container_kind").withColumn("fill_share", F.round(F.col("used_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
