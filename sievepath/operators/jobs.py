"""Whole jobs put together from the operators: fetching, compiling, chunk indexes, threads as documents, daily runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from . import records, state


def fetched(df: DataFrame, fetch: Callable[[str], str], key: str, url: str, tries: int = 2) -> DataFrame:
    """(key, body) through an outside fetcher, inside the executors; what fails ``tries`` times is empty, no row is lost."""
    kind = df.schema[key].dataType.simpleString()

    def one(address: str | None) -> str:
        for _ in range(tries):
            try:
                return fetch(address) if address else ""
            except Exception:  # noqa: BLE001 - whatever the outside fetcher raises
                continue
        return ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "body": [one(u) for u in f["_url"]]})

    return df.select(key, F.col(url).alias("_url")).mapInPandas(run, f"{key} {kind}, body string")


def enriched(items: DataFrame, details: DataFrame, key: str, body: str) -> DataFrame:
    """Items with the fetched body where it is not blank, else their own."""
    new = details.select(key, F.col("body").alias("_new"))
    kept = [c for c in items.columns if c != body]
    better = F.when(text.strip(F.coalesce("_new", F.lit(""))) != "", F.col("_new")).otherwise(F.col(body))
    return items.join(new, key, "left").select(*kept, better.alias(body))


def compiled(files: DataFrame, done: DataFrame, reply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``files``: (name, value). Those without an output yet, their front matter's tags and title, and the model's JSON
    merged over them, its values first. ``reply`` maps (name, value) to (name, reply)."""
    todo = files.join(done.select("name"), "name", "left_anti")
    block = text.front_matter(F.col("value"))
    own = F.map_filter(F.create_map(F.lit("title"), text.front_value(block, "title"), F.lit("source"), text.front_value(block, "source")), lambda _, v: v.isNotNull())
    said = todo.join(reply(todo.select("name", "value")), "name", "left")
    theirs = F.coalesce(F.from_json(text.reply_json(F.col("reply")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    old = F.map_filter(own, lambda k, _: ~F.map_contains_key(theirs, k))
    return said.select("name", F.map_concat(old, theirs).alias("metadata"), (F.size(theirs) > 0).alias("from_model"))


def chunk_index(documents: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], size: int = 1200, overlap: int = 150) -> tuple[DataFrame, DataFrame]:
    """``documents``: (doc_id, text), ``cache``: (item_id, text_hash, vec) with chunks as items. (index, misses): a
    second build over the same texts has no misses and embeds nothing."""
    parts = records.chunks(documents, "doc_id", "text", size, overlap)
    items = parts.select(F.concat_ws("#", "doc_id", "chunk_no").alias("item_id"), F.lit("").alias("title"), F.col("chunk").alias("content"))
    _, misses = state.probe(items, cache)
    return state.embed_missing(items, cache, embed), misses


def thread_text(nodes: DataFrame, body: str) -> DataFrame:
    """One document a thread: its nodes depth first, each indented by its depth. ``nodes`` as for ``tree``, with ``body``."""
    placed = records.tree(nodes).join(nodes.select("id", body), "id").withColumn("root", F.split("path", "/")[0])
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.coalesce(F.col(body), F.lit("")))
    rows = placed.select("root", "path", line.alias("line"))
    return rows.groupBy("root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n"))


def frequent_topics(items: DataFrame, most: int = 8) -> DataFrame:
    """The deterministic stand-in for a model's profile: the words that most of a profile's titles have."""
    words = items.select("profile_id", "item_id", F.explode(text.word_tags(F.col("title"))).alias("topic")).distinct()
    n = words.groupBy("profile_id", "topic").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("n"), "topic"))
    return n.withColumn("place", place.cast("bigint")).where(F.col("place") <= most)


def first_of_each(rows: DataFrame, group: Column, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of a listing, in its order; 0 means all."""
    if most <= 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= most).drop("_n")


class Stages:
    """Times the actions of a run; a plan costs nothing until it is written."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    def run(self, name: str, action: Callable[[], object]) -> object:
        began = time.perf_counter()
        out = action()
        self.seconds[name] = round(time.perf_counter() - began, 3)
        return out


def daily(spark: SparkSession, steps: dict[str, Callable[[], object]], stop_on: tuple[str, ...] = ()) -> dict[str, str]:
    """Runs the steps in order. A failing step is reported and the next one runs, unless it is one of ``stop_on``."""
    out: dict[str, str] = {}
    for name, step in steps.items():
        try:
            step()
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001 - the report names it
            out[name] = f"failed: {type(e).__name__}"
            if name in stop_on:
                break
    return out


def deliver(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch to a sink outside (a note app, a folder) and ends at the present end of the stream; one
    batch at a time, so a job that is still running is never started again."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
