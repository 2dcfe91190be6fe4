"""At most ``limit`` records per contributor, kept by score, batch after batch.

The state table holds each contributor's kept records; the last of a full list is the contributor's
cutoff. A new batch first meets the cutoffs, so most rows of dominant contributors fall out before
anything is sorted. What passes is ranked inside (contributor, salt), with as many salts as the
batch has rows for, so a contributor with a third of all rows spreads over many tasks and leaves at
most ``limit`` rows a salt; these are merged with the kept lists and ranked once more. Whatever
falls out, new or kept before, is logged. The state of a stated folder is taken up by a later run.

Defined cases: null or blank contributors belong to nobody and are never displaced;
null or negative scores count as 0; equal scores keep the lower row id; repeated
records are rows of their own; an empty batch leaves the state as it is; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch

SALT_ROWS = 200_000  # rows of a batch that one salt stands for
BROADCAST_ROWS = 1_000_000  # cutoffs, some 40 bytes each, that are sent to all executors; more are joined
_ROW = "who string, score bigint, row_id bigint"


def contributor_key(raw: Column) -> Column:
    """Trimmed of any white space, lower case; null if nothing is left."""
    key = F.lower(F.regexp_replace(raw, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    return F.when(key != "", key)


def contributions(df: DataFrame, row: str, batch: str, contributor: str, score: str) -> DataFrame:
    """(who, score, row_id, batch_no) of the rows that belong to somebody."""
    return df.select(
        contributor_key(F.col(contributor)).alias("who"),
        F.greatest(F.coalesce(F.col(score), F.lit(0)), F.lit(0)).cast("bigint").alias("score"),
        F.col(row).cast("bigint").alias("row_id"),
        F.coalesce(F.col(batch), F.lit(0)).cast("int").alias("batch_no"),
    ).where("who is not null")


def _rank(score: str, row: str) -> Column:
    return F.struct(F.col(score).alias("score"), (-F.col(row)).alias("neg"))


def cutoffs(kept: DataFrame, limit: int) -> DataFrame:
    """(who, cut) of the contributors whose list is full."""
    by = kept.groupBy("who").agg(F.count("*").alias("n"), F.min(_rank("score", "row_id")).alias("cut"))
    return by.where(F.col("n") >= limit).select("who", "cut")


def merge_batch(kept: DataFrame | None, batch: DataFrame, limit: int, salts: int = 1) -> DataFrame:
    """All rows of state and batch with their fate: kept or displaced."""
    best = [F.desc("score"), F.asc("row_id")]
    rows, below = batch.select("who", "score", "row_id"), None
    if kept is not None:
        cut = cutoffs(kept, limit)
        small = cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        met = rows.join(F.broadcast(cut) if small else cut, "who", "left").withColumn("low", F.coalesce(_rank("score", "row_id") < F.col("cut"), F.lit(False))).drop("cut")
        rows, below = met.where("not low").drop("low"), met.where("low").drop("low")
    if salts > 1:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
        placed = salted.withColumn("place", F.row_number().over(Window.partitionBy("who", "salt").orderBy(*best))).drop("salt")
        low = placed.where(F.col("place") > limit).drop("place")
        rows, below = placed.where(F.col("place") <= limit).drop("place"), low if below is None else below.unionByName(low)
    if kept is not None:
        rows = rows.unionByName(kept.select("who", "score", "row_id"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("who").orderBy(*best)))
    out = ranked.select("who", "score", "row_id", F.when(F.col("place") > limit, "displaced").otherwise("kept").alias("fate"))
    return out if below is None else out.unionByName(below.withColumn("fate", F.lit("displaced")))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    done = [p for p in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version="))


def load_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The kept lists that an earlier run left in the folder; None if there are none."""
    found = _versions(spark, folder)
    return spark.read.schema(_ROW).parquet(f"{folder}/version={found[-1]}") if found else None


def save_state(kept: DataFrame, folder: str) -> None:
    """A new version beside the old ones, which is read only once it is complete."""
    found = _versions(kept.sparkSession, folder)
    kept.select("who", "score", "row_id").write.mode("overwrite").parquet(f"{folder}/version={found[-1] + 1 if found else 0}")


def cap_contributors(spark: SparkSession, rows: DataFrame, limit: int = 12, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Feeds the batches of ``rows`` (see contributions) in order; returns the final state and the log of displaced
    rows. With a ``state`` folder the kept lists of earlier runs are taken up and the new ones left there."""
    store = Scratch(spark, "capping")
    staged = store.write(rows, "staged", by="batch_no")
    batches = staged.groupBy("batch_no").agg(F.count("*").alias("n")).orderBy("batch_no").collect()
    kept, done = load_state(spark, state) if state else None, []
    for i, b in enumerate(batches):
        merged = merge_batch(kept, staged.where(F.col("batch_no") == b["batch_no"]), limit, -(-b["n"] // SALT_ROWS))
        store.write(merged, f"step={i}", by="fate")
        step = spark.read.schema(_ROW + ", fate string").parquet(store.path(f"step={i}"))
        kept = step.where("fate = 'kept'").drop("fate")
        done.append(store.path(f"step={i}"))
        if i > 1:
            store.drop(f"step={i - 2}/fate=kept")
    if state and kept is not None:
        save_state(kept, state)
    none = spark.createDataFrame([], _ROW)
    log = spark.read.schema(_ROW + ", fate string").option("basePath", store.root).parquet(*done).where("fate = 'displaced'").select("who", "score", "row_id") if done else none
    return (none if kept is None else kept), log
