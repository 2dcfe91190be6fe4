"""Readers of item files, notes, feeds and interaction logs; all with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

GENERIC = "id string, title string, content string, tags array<string>, metadata map<string,string>, _bad string"
PLATFORM = "id string, title string, content string, excerpt string, url string, tags array<string>, content_type string, voteup_count bigint, comment_count bigint, author struct<id:string,name:string>, metadata map<string,string>, _bad string"
IMPRESSION = "user_id bigint, answer_id bigint, impression_ts bigint, click_ts bigint"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row an object of a JSON array. A missing file or a broken one is an error, at the latest when read."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)


def _sound(df: DataFrame, path: str) -> DataFrame:
    kept = df.cache()
    if kept.where("_bad is not null").limit(1).count():
        raise ValueError(f"{path} is no JSON array of objects")
    return kept.drop("_bad")


def generic_items(spark: SparkSession, path: str) -> DataFrame:
    """Validated items: id, title, content not blank, tags and metadata given. All violations are counted in
    one pass and named in the error."""
    rows = _sound(json_array(spark, path, GENERIC), path)
    blank = lambda c: F.coalesce(text.strip(F.col(c)), F.lit("")) == ""
    tests = {c: blank(c) for c in ("id", "title", "content")} | {c: F.col(c).isNull() for c in ("tags", "metadata")}
    wrong = rows.agg(*[F.count_if(t).alias(c) for c, t in tests.items()]).first().asDict()
    if any(wrong.values()):
        raise ValueError("missing required fields: " + ", ".join(f"{c} in {n} rows" for c, n in wrong.items() if n))
    source = F.coalesce(F.col("metadata")["source"], F.lit("generic"))
    rest = F.map_filter("metadata", lambda k, _: k != "source")
    return rows.select(*[text.strip(F.col(c)).alias(c) for c in ("id", "title", "content")], F.filter(F.transform("tags", text.strip), lambda t: t != "").alias("tags"), F.map_concat(rest, F.create_map(F.lit("source"), source)).alias("metadata"))


def platform_items(spark: SparkSession, path: str) -> DataFrame:
    """Crawled items with defaults: empty content falls back to the excerpt, the author is flattened."""
    rows = _sound(json_array(spark, path, PLATFORM), path)
    body = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("excerpt", F.lit("")))
    extra = {"source": F.lit("platform"), "url": F.coalesce("url", F.lit("")), "author": F.coalesce("author.name", F.lit("")), "author_name": F.coalesce("author.name", F.lit("")), "author_id": F.coalesce("author.id", F.lit("")), "content_type": F.coalesce("content_type", F.lit("")), "voteup_count": F.coalesce("voteup_count", F.lit(0)).cast("string"), "comment_count": F.coalesce("comment_count", F.lit(0)).cast("string")}
    given = F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    metadata = given
    for k, v in extra.items():
        metadata = F.when(F.map_contains_key(metadata, k), metadata).otherwise(F.map_concat(metadata, F.create_map(F.lit(k), v)))
    return rows.select(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("title", F.lit("")).alias("title"), body.alias("content"), F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), text.strip), lambda t: t != "").alias("tags"), metadata.alias("metadata"), F.coalesce("url", F.lit("")).alias("url"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"generic": generic_items, "platform": platform_items}


def items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(READERS)}")
    return READERS[kind](spark, path)


def notes(spark: SparkSession, folder: str, most: int = 2000) -> DataFrame:
    """Markdown files below a folder: the digest of the path inside it as id, title from the front matter or the file's
    name, the body's first ``most`` characters, tags as a list."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"))
    block = text.front_matter(F.col("value"))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    title = F.coalesce(F.when(text.front_value(block, "title") != "", text.front_value(block, "title")), stem)
    body = F.substring(text.strip(F.regexp_replace("value", r"(?s)^---[ \t\r]*\n.*?\n---[ \t\r]*(?:\n|$)", "")), 1, most)
    inside = F.element_at(F.split("path", "/" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/", 2), -1)
    return rows.select(F.md5(inside).alias("id"), title.alias("title"), F.when(body != "", body).otherwise(title).alias("content"), F.coalesce(text.front_list(block, "tags"), F.array().cast("array<string>")).alias("tags"), F.lit(1.0).alias("popularity"), F.col("path"))


def feed(spark: SparkSession, path: str, most: int = 3) -> DataFrame:
    """The first ``most`` entries of each feed file, in file order; the summary stands in for a missing body."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("feed"), F.monotonically_increasing_id().alias("seq")) if "_metadata" in rows.columns else rows.select("*", F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("seq"))
    place = F.row_number().over(Window.partitionBy("feed").orderBy("seq"))
    kept = placed.withColumn("place", place).where(F.col("place") <= most)
    return kept.select(F.concat(F.lit("rss_"), F.substring(F.md5("link"), 1, 10)).alias("id"), F.coalesce("title", F.lit("")).alias("title"), text.html_text(F.coalesce("description", F.lit(""))).alias("content"), "link", F.lit(0.0).alias("popularity"), "feed")


def impressions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless interaction log; a click time of 0 means none."""
    return spark.read.schema(IMPRESSION).csv(path)


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.json", without: tuple[str, ...] = ("checkpoint", "state")) -> str | None:
    """The newest file by time, then name, leaving out names with a token of ``without``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    for token in without:
        rows = rows.where(~F.col("path").contains(token))
    best = rows.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return best["path"] if best else None
