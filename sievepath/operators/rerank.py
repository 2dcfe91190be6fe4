"""Second-stage ranking: fine vectors, evidence, prompts, typed replies, pluggable scorers.

Models are outside: a scorer is any function from the prompt table to (profile_id, item_id, reply). A missing
or unreadable reply takes the neutral score, so a failing model never loses a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vector

# What an unreadable reply counts as, and the limits of near-repeats and disliked items.
NEUTRAL, UNSURE = 5.0, 0.1
DUPLICATE, DISLIKED, GAMMA, MOST_PENALTY, DUPLICATE_SCORE = 0.95, 0.80, 1.5, 0.5, -999.0


def nearest_saved(top: DataFrame, cloud: DataFrame, k: int) -> DataFrame:
    """``top``: (profile_id, item_id, vec), ``cloud``: (profile_id, pos, size, vec), both of unit vectors. The ``k``
    saved vectors of each item's profile that are nearest: (profile_id, item_id, pos, size, sim, place)."""
    rows = top.join(cloud.select("profile_id", "pos", "size", F.col("vec").alias("saved")), "profile_id").select("profile_id", "item_id", "pos", "size", vector.dot(F.col("vec"), F.col("saved")).alias("sim"))
    place = F.row_number().over(Window.partitionBy("profile_id", "item_id").orderBy(F.desc(F.round("sim", 12)), "pos"))
    return rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= k)


def fine_i2i(top: DataFrame, cloud: DataFrame, k: int = 3, decay: float = 0.05) -> DataFrame:
    """The time-weighted mean of the ``k`` best cosines, for the items that a coarse stage kept."""
    w = F.exp(-F.lit(decay) * (F.col("size") - 1 - F.col("pos")))
    return nearest_saved(top, cloud, k).groupBy("profile_id", "item_id").agg((F.sum(F.col("sim") * w) / F.sum(w)).alias("i2i"))


def with_feedback(score: Column, disliked: Column, duplicate: Column) -> Column:
    """A near-repeat of a seen item goes last; likeness to disliked ones costs up to MOST_PENALTY."""
    penalty = F.least(GAMMA * disliked, F.lit(MOST_PENALTY))
    return F.when(duplicate > DUPLICATE, DUPLICATE_SCORE).when(disliked > DISLIKED, score - penalty).otherwise(score)


def exemplars(saved: DataFrame, most: int = 10, used: int = 5) -> DataFrame:
    """The titles of the first ``used`` of the first ``most`` saved items of each profile, in order."""
    first = saved.withColumn("n", F.row_number().over(Window.partitionBy("profile_id").orderBy("seq"))).where(F.col("n") <= most)
    titled = first.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("n", "title"))).alias("t"))
    return titled.select("profile_id", F.slice(F.filter(F.transform("t", lambda x: x["title"]), lambda x: x.isNotNull()), 1, used).alias("exemplars"))


def pointwise_prompt(topics: Column, styles: Column, negatives: Column, titles: Column, title: Column, content: Column) -> Column:
    """One item's question to a model: what the profile likes, then the item with the head of its text."""
    some = lambda c, n: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), ", ")
    shown = F.array_join(F.transform(F.slice(F.coalesce(titles, F.array().cast("array<string>")), 1, 5), lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")
    likes = F.when(some(negatives, 5) == "", "none").otherwise(some(negatives, 5))
    return F.format_string(
        "Saved before:\n%s\nTopics: %s\nStyles: %s\nDislikes: %s\nTitle: %s\nSummary: %s\nReply with JSON: relevance_score 0-10, confidence 0-1, reasoning, matched_topics, concerns.",
        shown, some(topics, 8), some(styles, 5), likes, F.coalesce(title, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 200),
    )


def cross_document(title: Column, content: Column) -> Column:
    """What a cross-encoder reads of an item."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(content, F.lit("")), 1, 300))


def reply_fields(reply: Column) -> dict[str, Column]:
    """relevance_score, confidence, reasoning, matched_topics, concerns of a reply. Numbers written as text count,
    other types take the default; a scalar list becomes a list of one; no readable object is neutral."""
    body = text.reply_json(reply)
    ok = F.get_json_object(body, "$").isNotNull()
    field = lambda k: F.get_json_object(body, f"$.{k}")
    number = lambda k, d: F.coalesce(field(k).try_cast("double"), F.lit(d))

    def many(k: str) -> Column:
        v = field(k)
        listed = F.from_json(v, "array<string>")
        return F.when(v.isNull() | (v == ""), F.array().cast("array<string>")).when(v.startswith("["), listed).otherwise(F.array(v))

    return {
        "relevance_score": F.when(ok, number("relevance_score", NEUTRAL)).otherwise(NEUTRAL),
        "confidence": F.when(ok, number("confidence", 0.5)).otherwise(UNSURE),
        "reasoning": F.when(ok, F.coalesce(field("reasoning"), F.lit(""))).otherwise(F.concat(F.lit("parse_failed: "), F.substring(F.coalesce(reply, F.lit("")), 1, 100))),
        "matched_topics": F.when(ok, many("matched_topics")).otherwise(F.array().cast("array<string>")),
        "concerns": F.when(ok, many("concerns")).otherwise(F.array(F.lit("parse_error"))),
    }


def rerank(top: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None, explicit: bool = True) -> DataFrame:
    """``top``: (profile_id, item_id, rank, prompt). Adds the reply's fields and the new order; without a scorer or an
    explicit profile the baseline order stays."""
    by = Window.partitionBy("profile_id")
    if scorer is None or not explicit:
        return top.withColumn("new_rank", F.col("rank").cast("bigint"))
    said = top.join(scorer(top.select("profile_id", "item_id", "prompt")), ["profile_id", "item_id"], "left")
    read = said.select(*top.columns, *[c.alias(n) for n, c in reply_fields(F.col("reply")).items()])
    return read.withColumn("new_rank", F.row_number().over(by.orderBy(F.desc("relevance_score"), "rank")).cast("bigint"))


def cross_encoded(top: DataFrame, score: Column | None) -> DataFrame:
    """A cross-encoder's share as ten points; a missing score is neutral."""
    return top.withColumn("relevance_score", F.coalesce(score * 10, F.lit(NEUTRAL)) if score is not None else F.lit(NEUTRAL))


def with_reasons(ranked: DataFrame, reasons: DataFrame, default: str = "") -> DataFrame:
    """New reasons replace old ones where there are any."""
    new = reasons.select("profile_id", "item_id", F.col("reason").alias("_new"))
    old = F.col("reason") if "reason" in ranked.columns else F.lit(None).cast("string")
    kept = [c for c in ranked.columns if c != "reason"]
    return ranked.join(new, ["profile_id", "item_id"], "left").select(*kept, F.coalesce("_new", old, F.lit(default)).alias("reason"))


def compressed(body: Column, reply: Column, short: int = 200, head: int = 500) -> Column:
    """Short texts stay; others take the model's text, or their head with a note where it failed."""
    return F.when(F.length(F.coalesce(body, F.lit(""))) < short, body).otherwise(F.coalesce(reply, F.concat(F.substring(body, 1, head), F.lit("\n...(not compressed, head only)"))))


def curation_prompt(ranked: DataFrame, anchor: Column) -> DataFrame:
    """One prompt a profile: its anchor and its items in order; a profile without items gets a fixed sentence."""
    block = F.concat(F.lit("## "), F.coalesce("title", F.lit("Untitled")), F.lit("\n"), F.coalesce("snippet", F.lit("")))
    rows = ranked.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    shown = F.array_join(F.transform("x", lambda r: r["b"]), "\n\n")
    return rows.select("profile_id", F.when(F.size("x") == 0, "Nothing new today.").otherwise(F.concat(F.lit("Anchor:\n"), anchor, F.lit("\n\nItems:\n"), shown)).alias("prompt"))
