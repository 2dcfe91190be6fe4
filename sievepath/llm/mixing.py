"""Sources mixed to target shares of the total size, with capped repeats.

Every listed source is cut into permuted blocks of documents by hash. A source's quota is its
share of the mix, in draws of blocks: the permuted list is gone through up to ``max_repeats``
times until the quota is reached. The draws of all sources are dealt to output shards by a
splitting tree: halves of the shard range get multivariate-hypergeometric parts of the exact
quotas, down to single shards, which then own disjoint ranges of each permuted list and order
their documents locally.

The mix is as large as the caps allow with exact shares, unless ``size`` says less. Shares of
sources without tokens cannot be met; the others share theirs in proportion.

Defined cases: sources are compared trimmed and in lower case; documents of unlisted or null
sources and a null or non-positive share or cap are used 0 times; null and empty texts have no
tokens and go with their block; repeated ids are documents of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch
from ._tokens import VOCABULARY, with_counts

BLOCKS = 2000  # at least, and four for each output shard
SHARD_TOKENS = 64_000_000
SOURCES = 1000
SEED = 17


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards x sources) draws, with column sums equal to the quotas and near equal row sums."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.array(quotas, dtype=np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        total = int(have.sum())
        part = total * (mid - low) // (high - low)
        # the marginals method takes counts below 10**9, far above the bounded number of blocks
        left = rng.multivariate_hypergeometric(have, part, method="marginals") if total else have.copy()
        todo += [(low, mid, left), (mid, high, have - left)]
    return out


class Mix:
    """A planned mix: ``uses`` of each document, ``shares`` of each source, ``order`` of the output."""

    def __init__(self, spark: SparkSession, documents: DataFrame, target: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, size: int | None = None, shards: int | None = None, seed: int = SEED):
        self.spark, self.seed = spark, seed
        store = Scratch(spark, "mixing")
        rows = target.groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(SOURCES + 1).collect()
        if len(rows) > SOURCES:
            raise ValueError(f"more than {SOURCES} sources in the target")
        self.target = sorted((r["source"], float(r["share"] or 0), int(r["cap"] or 0)) for r in rows if r["source"])
        named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), F.col(text).alias("text"))
        counted = store.write(with_counts(named, "text", vocabulary).withColumn("row_no", F.monotonically_increasing_id()), "documents")
        tokens = counted.agg(F.sum("n_tokens")).first()[0] or 0
        self.shards = shards or max(8, -(-tokens // SHARD_TOKENS))  # the shards grow in number, not in size
        block = F.pmod(F.xxhash64(F.coalesce("doc_id", "row_no"), F.lit(seed)), F.lit(max(BLOCKS, 4 * self.shards))).cast("int")
        self.documents = counted.withColumn("block", block)
        listed = [s for s, share, cap in self.target if share > 0 and cap > 0]
        sums = self.documents.where(F.col("source").isin(listed)).groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect() if listed else []
        self._plan(sums, size)  # sources x blocks rows

    def _plan(self, sums: list, size: int | None) -> None:
        blocks: dict[str, list[tuple[int, int]]] = {}
        for r in sums:
            blocks.setdefault(r["source"], []).append((r["block"], r["tokens"]))
        total = {s: sum(t for _, t in b) for s, b in blocks.items()}
        able = {s: (share, cap) for s, share, cap in self.target if total.get(s)}
        weight = sum(share for share, _ in able.values())
        self.size = min((cap * total[s] * weight / share for s, (share, cap) in able.items()), default=0.0)
        if size is not None:
            self.size = min(self.size, float(size))
        self.draws: dict[str, list[int]] = {}
        for s, (share, cap) in able.items():
            quota = self.size * share / weight
            order = sorted(blocks[s], key=lambda b: (np.random.default_rng([self.seed, b[0]]).random(), b[0]))
            rounds = min(int(quota // total[s]), cap)
            drawn, used = [b for b, _ in order] * rounds, rounds * total[s]
            if rounds < cap:
                over = None
                for b, t in order:
                    if used + t <= quota:
                        drawn.append(b)
                        used += t
                    elif over is None or t < over[1]:
                        over = (b, t)
                if over and used + over[1] - quota < quota - used:  # nearer with the least block too many
                    drawn.append(over[0])
            self.draws[s] = drawn
        self.sources = sorted(self.draws)
        self.parts = split_quotas([len(self.draws[s]) for s in self.sources], self.shards, self.seed)

    def _drawn(self) -> DataFrame:
        """(source, block, use_no, shard) of every draw; bounded by sources x BLOCKS x caps."""
        rows = []
        for j, s in enumerate(self.sources):
            shard = np.repeat(np.arange(self.shards), self.parts[:, j]).tolist()
            times: dict[int, int] = {}
            for b, k in zip(self.draws[s], shard):
                times[b] = times.get(b, 0) + 1
                rows.append((s, b, times[b], int(k)))
        return self.spark.createDataFrame(rows, "source string, block int, use_no int, shard int")

    def uses(self) -> DataFrame:
        n = self._drawn().groupBy("source", "block").agg(F.count("*").alias("uses"))
        return self.documents.join(F.broadcast(n), ["source", "block"], "left").select("doc_id", "source", "n_tokens", F.coalesce("uses", F.lit(0)).alias("uses"))

    def shares(self) -> DataFrame:
        got = self.uses().groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed_tokens"))
        total = float(got.agg(F.sum("mixed_tokens")).first()[0] or 0)
        wanted = self.spark.createDataFrame(self.target or [("", 0.0, 0)], "source string, target_share double, max_repeats int")
        share = F.when(F.lit(total) > 0, F.coalesce("mixed_tokens", F.lit(0)) / F.lit(total)).otherwise(F.lit(0.0))
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_uses", "most_uses", "mixed_tokens")]
        return wanted.join(got, "source", "left").select("source", "target_share", "max_repeats", *zero, F.round(share, 6).alias("actual_share"))

    def order(self) -> DataFrame:
        """(shard, place, doc_id, use_no): the mixed sequence of each output shard."""
        rows = self.documents.join(F.broadcast(self._drawn()), ["source", "block"])
        local = Window.partitionBy("shard").orderBy(F.xxhash64("row_no", "use_no", F.lit(self.seed)), "row_no", "use_no")
        return rows.select("shard", F.row_number().over(local).alias("place"), "doc_id", "use_no")
