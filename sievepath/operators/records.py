"""Deduplication, version choice, trees and exports of stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# How far each way of reading a detail page is trusted.
DETAIL_PRIORITY = {"js-initialData": 3, "dom_fallback": 2, "dom": 2, "blocked_or_summary_fallback": 1, "summary": 1}


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; never an arbitrary one."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def dedupe_key(id_: Column, url: Column, title: Column, author: Column, excerpt: Column, row: Column) -> Column:
    """id unless unknown, else url, else title and author, else the excerpt's head, else the row itself."""
    t, a, e = (text.strip(F.coalesce(c, F.lit(""))) for c in (title, author, excerpt))
    return (
        F.when((F.coalesce(id_, F.lit("")) != "") & ~id_.startswith("unknown_"), F.concat(F.lit("id:"), id_))
        .when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), url))
        .when((t != "") | (a != ""), F.concat(F.lit("title_author:"), t, F.lit("::"), a))
        .when(e != "", F.concat(F.lit("excerpt:"), F.substring(e, 1, 80)))
        .otherwise(F.concat(F.lit("fallback:"), row.cast("string")))
    )


def detail_priority(source: Column) -> Column:
    out = F.lit(0)
    for name, value in DETAIL_PRIORITY.items():
        out = F.when(source == name, value).otherwise(out)
    return out


def best_version(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the most trusted detail, then the longest content, then the latest time;
    the later row wins ties. ``df`` has priority, length and stamp besides."""
    w = Window.partitionBy(key).orderBy(F.desc("priority"), F.desc("length"), F.desc("stamp"), F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def versions(content: DataFrame) -> DataFrame:
    """Crawled records with what decides between their versions."""
    stamp = F.coalesce(text.time_digits(F.col("updated_time")), text.time_digits(F.col("created_time")), F.lit(0).cast("decimal(38,0)"))
    key = dedupe_key(F.col("id"), F.col("url"), F.col("title"), F.col("author.name"), F.col("excerpt"), F.col("row_id"))
    return content.select("row_id", "batch_no", key.alias("key"), detail_priority(F.col("metadata")["detail_source"]).alias("priority"), F.length(F.coalesce("content", F.lit(""))).alias("length"), stamp.alias("stamp"))


def upsert(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The aggregate after a batch: the better version of each key."""
    rows = batch if state is None else state.unionByName(batch)
    return best_version(rows, "key", "row_id")


def flat(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns joined by ``sep``; maps and arrays as JSON. Clashing names get a number."""
    out: list[Column] = []
    seen: dict[str, int] = {}

    def walk(col: Column, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(col.getField(f.name), f"{name}{sep}{f.name}" if name else f.name, f.dataType)
            return
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            name = f"{name}{sep}{seen[name]}"
        out.append((F.to_json(col) if isinstance(kind, (T.MapType, T.ArrayType)) else col).alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*out)


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared checkpoint folder; without one (tests) the rows are kept in memory."""
    held = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return df.checkpoint() if held else df.persist()


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    """Adds place, the rank over all rows, without one task for all: ranges are sorted apart, and the sizes of the
    ranges before, one number a task, are added."""
    ranged = _cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, seen = [], 0
    for r in sizes:
        starts.append((r["_part"], seen))
        seen += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("place", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_m", "_part", "_before")


def tree(nodes: DataFrame) -> DataFrame:
    """``nodes``: (id, parent, score, posted). Adds depth and path, by which depth-first order sorts: siblings
    by score and time, best first. Nodes whose parent is missing are roots. Level by level until one is empty, each
    written; nodes that no root reaches (a cycle) are an error."""
    ids = nodes.select(F.col("id").alias("parent")).distinct()
    order = [F.desc("score"), F.desc("posted"), F.asc("id")]
    roots = nodes.join(ids, "parent", "left_anti").withColumn("parent", F.lit(None).cast(nodes.schema["parent"].dataType))
    rest = _cut(nodes.join(ids, "parent", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(*order))))
    level = _cut(_placed(roots, *order).select("id", "parent", F.lit(0).alias("depth"), F.format_string("%08d", "place").alias("path")))
    out, depth, reached = level, 0, level.count()
    while True:
        depth += 1
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("up"))
        level = _cut(rest.join(up, "parent").select("id", "parent", F.lit(depth).alias("depth"), F.concat_ws("/", "up", F.format_string("%08d", "place")).alias("path")))
        n = level.count()
        if not n:
            break
        out, reached = out.unionByName(level), reached + n
    if reached < nodes.count():
        raise ValueError("some nodes are their own ancestors")
    return out


def gap_free(present: DataFrame, group: str, order: str) -> DataFrame:
    """How many rows of each group, in order, are present before the first that is not."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = present.withColumn("_ok", F.min(F.col("present").cast("int")).over(w))
    return run.groupBy(group).agg(F.sum("_ok").cast("bigint").alias("prefix"), F.count("*").alias("n"))


def chunks(df: DataFrame, id_: str, body: str, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(id, chunk_no, start_pos, chunk): windows of ``size`` characters that share ``overlap``; the last is shorter.
    Empty and null texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap
    n = F.greatest(F.ceil((F.length(body) - overlap) / F.lit(step)), F.lit(1))
    rows = df.where(F.length(body) > 0).select(id_, body, F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("chunk_no"))
    return rows.select(id_, "chunk_no", (F.col("chunk_no") * step + 1).alias("start_pos"), F.substring(F.col(body), (F.col("chunk_no") * step + 1).cast("int"), F.lit(size)).alias("chunk"))
