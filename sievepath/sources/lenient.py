"""Scans that take what they can get: embedded JSON, mixed payloads, references, listings, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

# What a page or log says when nothing was fetched.
EMPTY_MARKERS = ("未找到任何收藏夹", "未获取到任何内容", "收藏夹列表页访问失败", "成功爬取 0 条内容", "找到 0 个收藏夹")


def embedded_state(page: Column, script_id: str) -> Column:
    """The JSON of a page's state script; empty without one."""
    return F.regexp_extract(F.coalesce(page, F.lit("")), rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)


def state_entity(state: Column, kind: str, key: Column, fields: list[str]) -> dict[str, Column]:
    """Fields of ``entities.<kind>[key]``; null where missing."""
    entity = F.element_at(F.from_json(F.get_json_object(state, f"$.entities.{kind}"), "map<string,string>"), key)
    return {f: F.get_json_object(entity, f"$.{f}") for f in fields}


def first_filled(parts: dict[str, Column]) -> tuple[Column, Column]:
    """(value, name of its part): the first that is not blank, in the order given; the last part's name if none is."""
    filled = lambda c: text.strip(F.coalesce(c, F.lit(""))) != ""
    names = list(parts)
    value = F.coalesce(*[F.when(filled(c), c) for c in parts.values()])
    where = F.lit(names[-1])
    for n in reversed(names):
        where = F.when(filled(parts[n]), n).otherwise(where)
    return value, where


def payload_records(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Whole files that hold a list of records or an object with ``items``; what is no object is dropped, fields take
    their type or null. Keyed by id, else url; the last record of a key in file order wins."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    body = F.when(text.strip(F.col("value")).startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.items"))
    rows = files.select("file", F.posexplode(F.from_json(body, "array<string>")).alias("place", "record")).where(F.col("record").startswith("{"))
    typed = rows.select("file", "place", *[F.get_json_object("record", f"$.{n}").try_cast(t).alias(n) for n, t in fields.items()])
    keyed = typed.withColumn("key", F.coalesce(*[F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.col(k).cast("string")) for k in ("id", "url") if k in fields], F.concat_ws("#", "file", "place")))
    last = Window.partitionBy("key").orderBy(F.desc("file"), F.desc("place"))
    return keyed.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "file", "place")


def references(notes: DataFrame, id_: str, body: str, pattern: str) -> DataFrame:
    """(source, target) of every reference, once a note; ``pattern`` has the target as its group."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(pattern), 1)))
    return notes.select(F.col(id_).alias("source"), found.alias("target"))


def backlinks(refs: DataFrame) -> DataFrame:
    """How many notes refer to each target, and the first of them."""
    return refs.groupBy("target").agg(F.count("*").alias("n"), F.min("source").alias("first_source"))


def is_id(c: Column, pattern: str = r"^\d{14}-[a-z0-9]{7}$") -> Column:
    return text.strip(F.coalesce(c, F.lit(""))).rlike(pattern)


def anchors(asked: DataFrame, blocks: DataFrame, pattern: str, default: str) -> DataFrame:
    """``asked``: (anchor_id, anchor). An id gives the text of its block or, if there is none, the default; what is no
    id stands for itself. ``blocks``: (block_id, body)."""
    a = asked.withColumn("_key", text.strip(F.coalesce("anchor", F.lit(""))))
    named = a.join(blocks.select(F.col("block_id").alias("_key"), "body"), "_key", "left")
    body = F.when(is_id(F.col("_key"), pattern), F.when(text.strip(F.coalesce("body", F.lit(""))) != "", F.col("body")).otherwise(F.lit(default))).otherwise(F.col("_key"))
    return named.select("anchor_id", body.alias("text"))


def anchor_file(spark: SparkSession, path: str) -> str:
    """A single note, stripped; empty if it cannot be read."""
    try:
        rows = spark.read.text(path, wholetext=True).select(text.strip(F.col("value"))).take(1)
    except Exception:  # a missing file is an empty anchor
        return ""
    return rows[0][0] if rows else ""


def listing(docs: DataFrame, notebook: Column, id_: str) -> DataFrame:
    """Notebooks with their number of documents, the first and the last."""
    return docs.where(notebook.isNotNull()).groupBy(notebook.alias("notebook")).agg(F.count("*").alias("n"), F.min(id_).alias("first_id"), F.max(id_).alias("last_id"))


def posts_between(posts: DataFrame, posted: str, body: str, author: str, start: str, end: str) -> DataFrame:
    """Posts of a time range; rows without a time or text are dropped, a missing author is Unknown."""
    at = F.col(posted).cast("timestamp")
    rows = posts.where(at.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & (text.strip(F.coalesce(F.col(body), F.lit(""))) != ""))
    name = text.strip(F.coalesce(F.col(author), F.lit("")))
    return rows.withColumn(author, F.when(name == "", "Unknown").otherwise(F.col(author))).withColumn("posted_text", F.date_format(at, "yyyy-MM-dd HH:mm"))


def folders(cards: DataFrame, url: str, label: str, order: str) -> DataFrame:
    """Cards that have a link and a count; the first of each link, with the count and a constant label."""
    n = F.regexp_extract(F.regexp_replace(F.coalesce(F.col(label), F.lit("")), ",", ""), r"(\d+)", 1)
    rows = cards.where((F.coalesce(F.col(url), F.lit("")) != "") & (n != "")).withColumn("n_items", n.try_cast("bigint")).withColumn("label", F.lit(1))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(order))).where("_n = 1").drop("_n")


def expected_total(texts: Column, pattern: str) -> Column:
    """The greatest number that any match of ``pattern`` holds; null without a match."""
    return F.array_max(F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(texts, F.lit("")), ",", ""), F.lit(pattern), 1), lambda x: x.try_cast("bigint")))


def looks_empty(log: Column) -> Column:
    return F.coalesce(log, F.lit("")).rlike("|".join(EMPTY_MARKERS))


def output_paths(log: Column) -> Column:
    """The JSON files that a log names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(r"([A-Za-z0-9_./-]+\.json)"), 1))


def head_csv(spark: SparkSession, path: str, most: int) -> DataFrame:
    """The first ``most`` lines of one gzip file, which Spark reads as one partition, in their order."""
    return spark.read.text(path).limit(most)


def manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n_lines, n_chars) of a subset."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count("*").alias("n_lines"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("n_chars"))
        out = row if out is None else out.unionByName(row)
    return out
