"""The pN_ queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capping, history, mixing, nearcopy, packing, pii, truncation, vectors
from .sql import ORACLES


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "zhihu_content").select("row_id", F.col("metadata").getItem("source").alias("source"), "content", "excerpt")
    return truncation.judged(spark, rows)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("why is not null").select("row_id", "field")


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(_judged(spark, sf))


def _near(spark: SparkSession, sf: str):
    return nearcopy.near_pairs(spark, nearcopy.usable_items(_table(spark, sf, "candidate_item")), threshold=0.7)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearcopy.item_pairs(*_near(spark, sf))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return nearcopy.groups(spark, *_near(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = capping.contributions(_table(spark, sf, "zhihu_content"), "row_id", "batch_no", "author.id", "voteup_count")
    return capping.cap_contributors(spark, rows, limit=12)[1].select("row_id")


def p3_kept(spark: SparkSession, sf: str) -> DataFrame:
    rows = capping.contributions(_table(spark, sf, "zhihu_content"), "row_id", "batch_no", "author.id", "voteup_count")
    kept = capping.cap_contributors(spark, rows, limit=12)[0]
    return kept.groupBy(F.col("who").alias("author_id")).agg(F.count("*").alias("n_kept"), F.max("score").alias("best_votes"), F.min("score").alias("cutoff_votes"))


_FIELDS = {"embedding": 64, "embedding_fine": 128}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    items, out = _table(spark, sf, "candidate_item"), None
    for field, length in _FIELDS.items():
        pairs = vectors.similar_pairs(spark, vectors.fit_rows(items, field, length), floor=0.92)
        part = vectors.mutual(pairs, k=10).select(F.lit(field).alias("field"), "item_id_a", "item_id_b")
        out = part if out is None else out.unionByName(part)
    return out


def p4_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every item whose seq is divisible by 20, against all items."""
    items, out = _table(spark, sf, "candidate_item"), None
    for field, length in _FIELDS.items():
        all_ = vectors.usable(items, field, length)
        part = vectors.nearest(spark, all_, all_.where("seq % 20 = 0"), k=10).select(F.lit(field).alias("field"), "item_id", "neighbour_id", "place", F.round("cosine", 6).alias("cosine"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return history.replay(spark, _table(spark, sf, "zhihu_content").select("row_id", "batch_no", "id", "content"))


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf, "documents"), _table(spark, sf, "pack_container"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p6_pack(spark, sf), _table(spark, sf, "pack_container"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mix(spark, _table(spark, sf, "documents"), _table(spark, sf, "mix_target")).uses()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mix(spark, _table(spark, sf, "documents"), _table(spark, sf, "mix_target")).shares()


def p7_order(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.Mix(spark, _table(spark, sf, "documents"), _table(spark, sf, "mix_target")).order()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.Finder(spark, _table(spark, sf, "documents")).spans().select("doc_id", "kind", "start_pos")


def p8_masked(spark: SparkSession, sf: str) -> DataFrame:
    return pii.Finder(spark, _table(spark, sf, "documents")).masked()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
