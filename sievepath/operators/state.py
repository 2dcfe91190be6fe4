"""What a run keeps and a later one takes up: saved tables, the embedding cache, checkpoints, guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

# How much of a listing is read again on the next run.
OVERLAP, TAIL_WINDOW = 30, 300


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under its name; Spark's commit makes each appear whole or not at all."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def save_run(ranked: DataFrame, config: dict, summary: DataFrame, folder: str) -> None:
    """The artefacts of a run as JSON lines: its settings, what went in, what came out with scores of six digits."""
    spark = ranked.sparkSession
    kinds = dict(ranked.dtypes)
    ranked.select(*[F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in ranked.columns]).write.mode("overwrite").json(f"{folder}/recommendations")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(config.items())], "key string, value string").write.mode("overwrite").json(f"{folder}/run_config")
    summary.write.mode("overwrite").json(f"{folder}/input_summary")


def append_log(rows: DataFrame, folder: str) -> None:
    """A resumable run's log; each call adds files."""
    rows.write.mode("append").json(folder)


def text_key(title: Column, content: Column) -> Column:
    return F.sha2(text.candidate_text(title, content), 256)


def probe(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items``: (item_id, title, content), ``cache``: (item_id, text_hash, vec). Hits with their vector, and
    misses: an id that is new or whose text has changed. Texts travel nowhere, only their hashes."""
    keyed = items.select("item_id", "title", "content", text_key(F.col("title"), F.col("content")).alias("text_hash"))
    hits = keyed.select("item_id", "text_hash").join(cache, ["item_id", "text_hash"])
    return hits, keyed.join(cache.select("item_id", "text_hash"), ["item_id", "text_hash"], "left_anti")


def embed_missing(items: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The new cache: hits as they are, misses through ``embed`` ((item_id, text_hash, title, content) to (item_id,
    text_hash, vec)); entries of ids that are gone fall out."""
    hits, misses = probe(items, cache)
    return hits.select("item_id", "text_hash", "vec").unionByName(embed(misses).select("item_id", "text_hash", "vec"))


def seeded(detail: DataFrame, index: DataFrame, key: str, order: str) -> DataFrame:
    """An aggregate from two checkpoints: the detailed record of a key if there is one, else the listed one."""
    both = detail.withColumn("_source", F.lit(0)).unionByName(index.withColumn("_source", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_source", order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("from_detail", F.col("_source") == 0).drop("_n", "_source")


def start_index(current: Column, previous: Column) -> Column:
    """Where a listing is read from: a little before the last end if it has grown, else its tail."""
    return F.when(previous <= 0, F.lit(0)).when(current > previous, F.greatest(F.lit(0), previous - OVERLAP)).otherwise(F.greatest(F.lit(0), current - TAIL_WINDOW))


def is_complete(stop_reason: Column, expected: Column, count: Column) -> Column:
    """A checkpoint that need not be read on: all were found, or the pages ended with all that were expected."""
    said = F.trim(F.coalesce(stop_reason, F.lit("")))
    return (said == "expected_total_reached") | ((said == "no_next") & F.coalesce(count >= expected, F.lit(True)))


def is_reusable(complete: Column, stop_reason: Column, expected: Column, count: Column, target: Column) -> Column:
    full = complete & (count > 0)
    said = F.trim(F.coalesce(stop_reason, F.lit("")))
    return F.when(target > 0, full & (count >= target)).otherwise(full & ~said.isin("target_count", "max_pages") & is_complete(stop_reason, expected, count))


def changes(before: DataFrame, after: DataFrame, key: str, rank: str) -> DataFrame:
    """One row: how many keys an upsert added, how many it raised to a better version, and the total."""
    both = after.select(key, F.col(rank).alias("now")).join(before.select(key, F.col(rank).alias("was")), key, "left")
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now") > F.col("was")).alias("upgraded"))


def resumability(counts: DataFrame) -> DataFrame:
    """``counts``: (part, present boolean, total). Whether all parts are there and their totals agree."""
    return counts.agg(F.bool_and("present").alias("files_exist"), (F.min("total") == F.max("total")).alias("totals_aligned"))


def require_inputs(collection: DataFrame, candidates: DataFrame, cloud: DataFrame | None = None) -> None:
    """Stops with a plain message before any work is done on empty input."""
    for name, df in (("collection", collection), ("candidates", candidates), ("profile vectors", cloud)):
        if df is not None and df.isEmpty():
            raise ValueError(f"no {name} left to work with")


def edited(profiles: DataFrame, topics: dict[int, list[str]], negatives: dict[int, list[str]]) -> DataFrame:
    """Profiles with topics and negative tags added, each once, and a new stamp where anything was."""
    def added(column: str, new: dict) -> Column:
        out = F.col(column)
        for pid, values in sorted(new.items()):
            more = F.array(*[F.lit(v) for v in values])
            out = F.when(F.col("profile_id") == pid, F.array_union(F.coalesce(F.col(column), F.array().cast("array<string>")), more)).otherwise(out)
        return out

    touched = F.col("profile_id").isin(*sorted({*topics, *negatives}))
    return profiles.withColumns({"core_topics": added("core_topics", topics), "negative_tags": added("negative_tags", negatives), "updated_at": F.when(touched, F.current_timestamp()).otherwise(F.col("updated_at"))})


def known_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The known fields of a stored record with their types; unknown ones are dropped, missing ones are null."""
    return df.select(*[(F.col(f"`{n}`").try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields.items()])
