"""The engine's relations over the stored tables, with an explicit order in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vector

LENGTH = 64
MOST_SAVED = 50


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One row an item: the values delivered last, at the place of the first delivery."""
    rows = read(spark, sf, "candidate_item").withColumn("item_id", text.strip(F.col("item_id"))).where("item_id <> ''")
    # only ids and places are grouped, and only ids delivered again (few) meet the rows with their texts and vectors
    again = rows.groupBy("item_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).where("first_seq < last_seq")
    last = rows.join(again, "item_id", "left").where("last_seq is null or seq = last_seq")
    usable = F.when(vector.is_usable(F.col("embedding"), LENGTH), F.col("embedding"))
    return last.select("item_id", F.coalesce("first_seq", "seq").alias("seq"), "title", "content", usable.alias("embedding"), "tags", "source", "popularity", "metadata")


def saved(spark: SparkSession, sf: str) -> DataFrame:
    """The collections, first copy of each item a profile; blank ids are dropped."""
    rows = read(spark, sf, "collection_item").withColumn("item_id", text.strip(F.col("item_id"))).where("item_id <> ''")
    w = Window.partitionBy("profile_id", "item_id").orderBy("seq")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def cloud(spark: SparkSession, sf: str, most: int = MOST_SAVED) -> DataFrame:
    """(profile_id, pos, size, vec): unit vectors of the first ``most`` saved items that have one."""
    rows = saved(spark, sf).select("profile_id", "seq", "item_id")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("profile_id").orderBy("seq"))).where(F.col("n") <= most)
    known = candidates(spark, sf).where("embedding is not null").select("item_id", "embedding")
    w = Window.partitionBy("profile_id")
    both = first.join(known, "item_id")
    return both.select("profile_id", (F.row_number().over(w.orderBy("seq")) - 1).alias("pos"), F.count("*").over(w).alias("size"), vector.unit(F.col("embedding")).alias("vec"))


def profile_ids(spark: SparkSession, sf: str, most: int = 100_000) -> list[int]:
    """The ids of the profile table, which is small by nature; more than ``most`` is an error."""
    ids = [r[0] for r in read(spark, sf, "user_explicit_profile").select("profile_id").distinct().orderBy("profile_id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} profiles: rank them in groups")
    return ids


def open_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every profile with every candidate that it has not saved: (profile_id, item_id, seq)."""
    pool = candidates(spark, sf).select("item_id", "seq")
    pairs = pool.select("item_id", "seq", F.explode(F.array(*[F.lit(p).cast("bigint") for p in profile_ids(spark, sf)])).alias("profile_id"))
    return pairs.join(saved(spark, sf).select("profile_id", "item_id"), ["profile_id", "item_id"], "left_anti")
