"""Writers of results: tables, flat exports, briefings, and a write that never loses rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import flat


def export(df: DataFrame, folder: str, name: str) -> tuple[str, str]:
    """The same rows as JSON lines and, flattened, as CSV with a header."""
    a, b = f"{folder}/{name}.json", f"{folder}/{name}.csv"
    df.write.mode("overwrite").json(a)
    flat(df).write.mode("overwrite").csv(b, header=True)
    return a, b


def keep_richer(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Replaces the table only if the new one has at least as many rows; says whether it did."""
    try:
        old = spark.read.parquet(path).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = -1
    if df.count() < old:
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def briefing(ranked: DataFrame) -> DataFrame:
    """(profile_id, markdown): an entry with a feedback panel for each ranked item (profile_id, rank, item_id, title)."""
    panel = F.format_string("<!-- item_id: %s -->\n**[panel]**\n- [ ] like\n- [ ] dislike: [ ] topic [ ] shallow [ ] source [ ] seen\n", "item_id")
    entry = F.concat(F.format_string("## %d. %s\n", "rank", F.coalesce("title", F.lit(""))), panel)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry")))), lambda x: x["entry"]), "\n")
    return ranked.groupBy("profile_id").agg(body.alias("markdown"))


def briefing_feedback(briefings: DataFrame) -> DataFrame:
    """The ticked boxes of a briefing: (profile_id, item_id, liked, disliked, topic, shallow, source, seen), where any is."""
    each = briefings.select("profile_id", F.explode(F.split("markdown", r"<!-- item_id: ")).alias("part")).where("part like '%-->%'")
    tick = lambda name: F.lower(F.regexp_extract("part", rf"\[(.)\] {name}", 1)) == "x"
    out = each.select("profile_id", F.trim(F.regexp_extract("part", r"^(.*?) -->", 1)).alias("item_id"), tick("like").alias("liked"), tick("dislike").alias("disliked"), *[tick(n).alias(n) for n in ("topic", "shallow", "source", "seen")])
    return out.where("liked or disliked")
