"""Queries of reranking, caches, comparisons, saved state and lenient scans with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import arena, extension, jobs, rerank, scoring, state
from ..operators import evaluation as ev
from ..operators import records as rec
from ..sources import lenient
from ..sources import tables as t
from . import base_sql as b
from .data_queries import _CUT, _SPLIT, _folder, _parts

Q: dict = {}
SQL: dict = {}
ST = b.strip


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _fine(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, seq, popularity, vec): unit fine vectors of the last delivery of each item that has a usable one."""
    rows = t.read(spark, sf, "candidate_item").withColumn("item_id", text.strip(F.col("item_id"))).where("item_id <> ''")
    w = Window.partitionBy("item_id")
    last = rows.select("item_id", "seq", "popularity", "embedding_fine").withColumn("rn", F.row_number().over(w.orderBy(F.desc("seq")))).where("rn = 1")
    return last.where(vector.is_usable(F.col("embedding_fine"), 128)).select("item_id", "seq", "popularity", vector.unit(F.col("embedding_fine")).alias("vec"))


def _fine_cloud(spark: SparkSession, sf: str) -> DataFrame:
    first = t.saved(spark, sf).select("profile_id", "seq", "item_id").withColumn("n", F.row_number().over(Window.partitionBy("profile_id").orderBy("seq"))).where(F.col("n") <= t.MOST_SAVED)
    w = Window.partitionBy("profile_id")
    both = first.join(_fine(spark, sf).select("item_id", "vec"), "item_id")
    return both.select("profile_id", (F.row_number().over(w.orderBy("seq")) - 1).alias("pos"), F.count("*").over(w).alias("size"), "vec")


def _coarse(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most popular items with a fine vector, for every profile: what a coarse stage may hand over."""
    top = _fine(spark, sf).where("popularity is not null").orderBy(F.desc("popularity"), "item_id").limit(20)
    return t.read(spark, sf, "user_explicit_profile").select("profile_id").distinct().join(F.broadcast(top.select("item_id", "vec")))


_FINE = f"""
fine AS (SELECT item_id, seq, popularity, {b.unit('embedding_fine')} AS u FROM (SELECT {ST('item_id')} AS item_id, seq, popularity, embedding_fine, row_number() OVER (PARTITION BY {ST('item_id')} ORDER BY seq DESC) AS rn FROM candidate_item WHERE {ST('item_id')} <> '')
  WHERE rn = 1 AND len(embedding_fine) = 128 AND list_bool_and(list_transform(embedding_fine, lambda v: v IS NOT NULL AND isfinite(v))) AND list_bool_or(list_transform(embedding_fine, lambda v: v <> 0))),
ffirst AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq) AS n FROM saved),
fcloud AS (SELECT s.profile_id, row_number() OVER (PARTITION BY s.profile_id ORDER BY s.seq) - 1 AS pos, count(*) OVER (PARTITION BY s.profile_id) AS size, c.u AS vec FROM ffirst s JOIN fine c ON s.item_id = c.item_id WHERE s.n <= 50),
ftop AS (SELECT p.profile_id, x.item_id, x.u FROM (SELECT DISTINCT profile_id FROM user_explicit_profile) p, (SELECT * FROM fine WHERE popularity IS NOT NULL ORDER BY popularity DESC, item_id LIMIT 20) x),
fnear AS (SELECT * FROM (SELECT k.profile_id, x.item_id, k.pos, k.size, list_dot_product(x.u, k.vec) AS sim, row_number() OVER (PARTITION BY k.profile_id, x.item_id ORDER BY round(list_dot_product(x.u, k.vec), 12) DESC, k.pos) AS place FROM ftop x JOIN fcloud k USING (profile_id)) WHERE place <= 3)"""


@query("fine_rescoring", f"WITH {b.SAVED}, {_FINE} SELECT profile_id, item_id, round(sum(sim * exp(-0.05::DOUBLE * (size - 1 - pos))) / sum(exp(-0.05::DOUBLE * (size - 1 - pos))), 6) AS i2i FROM fnear GROUP BY profile_id, item_id")
def _(spark, sf):
    return rerank.fine_i2i(_coarse(spark, sf), _fine_cloud(spark, sf)).withColumn("i2i", F.round("i2i", 6))


@query("evidence_topk", f"WITH {b.SAVED}, {_FINE} SELECT profile_id, item_id, place, pos, round(sim, 6) AS sim FROM fnear")
def _(spark, sf):
    """The three saved items that speak most for each coarse item of each profile."""
    return rerank.nearest_saved(_coarse(spark, sf), _fine_cloud(spark, sf), 3).select("profile_id", "item_id", "place", "pos", F.round("sim", 6).alias("sim"))


_PROBE = f"""pool AS (SELECT item_id, sha256({_CUT}) AS h FROM cand), cache AS (SELECT item_id, sha256({_CUT}) AS h FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS rk FROM (SELECT * REPLACE ({ST('item_id')} AS item_id) FROM collection_item) WHERE item_id <> '') WHERE rk = 1)"""


def _probe(spark, sf):
    saved = t.read(spark, sf, "collection_item").withColumn("item_id", text.strip(F.col("item_id"))).where("item_id <> ''")
    last = saved.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("seq")))).where("n = 1")
    cache = last.select("item_id", state.text_key(F.col("title"), F.col("content")).alias("text_hash"), F.array().cast("array<float>").alias("vec"))
    return t.candidates(spark, sf).select("item_id", "title", "content"), cache


@query("cache_hits_misses", f"WITH {b.CAND}, {_PROBE} SELECT CASE WHEN c.h = p.h THEN 'hit' WHEN c.h IS NULL THEN 'new' ELSE 'changed' END AS outcome, count(*) AS n, min(p.item_id) AS least FROM pool p LEFT JOIN cache c USING (item_id) GROUP BY ALL")
def _(spark, sf):
    """The cache holds the texts as the profiles saved them; the pool has them as last delivered."""
    items, cache = _probe(spark, sf)
    hits, misses = state.probe(items, cache)
    known = cache.select("item_id", F.lit(True).alias("known"))
    out = hits.select("item_id", F.lit("hit").alias("outcome")).unionByName(misses.join(known, "item_id", "left").select("item_id", F.when(F.col("known"), "changed").otherwise("new").alias("outcome")))
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.min("item_id").alias("least"))


@query("cache_fill", f"WITH {b.CAND}, {_PROBE} SELECT count(*) AS n, count(DISTINCT h) AS n_texts, 64::BIGINT AS dim FROM pool")
def _(spark, sf):
    """After a fill every item is cached; only the misses went through the embedder, here the hashing one."""
    items, cache = _probe(spark, sf)
    embedder = extension.HashingEmbedder(64)
    cache = cache.withColumn("vec", F.array_repeat(F.lit(0.0).cast("float"), 64))

    def missing(m: DataFrame) -> DataFrame:
        return m.select("item_id", "text_hash").join(extension.embed(m, embedder, "item_id", text.candidate_text(F.col("title"), F.col("content"))), "item_id")

    full = state.embed_missing(items, cache, missing)
    return full.agg(F.count("*").alias("n"), F.countDistinct("text_hash").alias("n_texts"), F.max(F.size("vec")).cast("bigint").alias("dim"))


@query("state_roundtrip", f"WITH {b.CAND}, {b.SAVED}, {b.CLOUD}, {b.PREFS} SELECT 'cloud' AS part, count(*) AS n, count(DISTINCT profile_id) AS n_profiles FROM cloud UNION ALL SELECT 'feedback', count(*), count(DISTINCT profile_id) FROM prefs UNION ALL SELECT 'profile', count(*), count(DISTINCT profile_id) FROM user_explicit_profile")
def _(spark, sf):
    """Saves the vector cloud, the feedback and the profiles, and reads them back."""
    folder = _folder(spark, "state")
    state.save({"cloud": t.cloud(spark, sf), "feedback": _prefs(spark, sf), "profile": t.read(spark, sf, "user_explicit_profile")}, folder)
    out = None
    for name, df in state.load(spark, folder, "cloud", "feedback", "profile").items():
        row = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.countDistinct("profile_id").alias("n_profiles"))
        out = row if out is None else out.unionByName(row)
    return out


def _prefs(spark, sf):
    from .ranking_queries import Q as ranking

    return ranking["feedback_prefs"](spark, sf)


@query("masked_metrics", f"""WITH {_SPLIT}, clean AS (SELECT DISTINCT user_id, item FROM parts WHERE part = 'train'), pop AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM parts WHERE part = 'train' GROUP BY item),
asked AS (SELECT q.part, q.user_id, q.item, q.clicked_at, q.shown_at, p.rank - count(s.item) AS rank FROM (SELECT parts.*, row_number() OVER () AS q_id FROM parts WHERE part <> 'train') q LEFT JOIN pop p ON p.item = q.item
  LEFT JOIN (SELECT c.user_id, c.item, p2.rank AS seen_rank FROM clean c JOIN pop p2 ON p2.item = c.item) s ON s.user_id = q.user_id AND s.seen_rank < p.rank GROUP BY q.q_id, q.part, q.user_id, q.item, q.clicked_at, q.shown_at, p.rank)
SELECT part, count(*) AS n_clicks, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hit_10, round(avg(CASE WHEN rank <= 50 THEN 1 ELSE 0 END), 6) AS recall_50, round(avg(CASE WHEN rank <= 100 THEN 1 ELSE 0 END), 6) AS recall_100, round(avg(CASE WHEN rank <= 50 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_50 FROM asked GROUP BY part""")
def _(spark, sf):
    return ev.masked_popularity(_parts(spark, sf))


_TWO = f"""{b.CAND}, pa AS (SELECT coalesce(source, 'unknown') AS source, item_id, popularity, row_number() OVER (PARTITION BY coalesce(source, 'unknown') ORDER BY popularity DESC NULLS LAST, item_id) AS rank FROM cand),
pb AS (SELECT coalesce(source, 'unknown') AS source, item_id, popularity, row_number() OVER (PARTITION BY coalesce(source, 'unknown') ORDER BY seq DESC) AS rank FROM cand),
la AS (SELECT * FROM pa WHERE rank <= 10), lb AS (SELECT * FROM pb WHERE rank <= 10),
games AS (SELECT a.source, a.item_id AS a_item, b.item_id AS b_item, a.rank AS a_rank, b.rank AS b_rank, CASE WHEN a.popularity > b.popularity THEN 'A' WHEN b.popularity > a.popularity THEN 'B' ELSE 'tie' END AS winner FROM la a JOIN lb b USING (source))"""


def _two_lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The ten most popular and the ten newest items of each source."""
    pool = t.candidates(spark, sf).select(F.coalesce("source", F.lit("unknown")).alias("source"), "item_id", "seq", "popularity")
    top = lambda *o: pool.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*o)).cast("bigint")).where("rank <= 10")
    return top(F.desc_nulls_last("popularity"), "item_id"), top(F.desc("seq"))


def _games(spark, sf) -> DataFrame:
    a, b_ = _two_lists(spark, sf)
    pop = t.candidates(spark, sf).select("item_id", "popularity")
    g = arena.matchups(a, b_, "source", "item_id").join(pop.select(F.col("item_id").alias("a_item"), F.col("popularity").alias("pa")), "a_item").join(pop.select(F.col("item_id").alias("b_item"), F.col("popularity").alias("pb")), "b_item")
    raw = F.when(F.col("pa") > F.col("pb"), F.col("a_item")).when(F.col("pb") > F.col("pa"), "b").otherwise("Draw")
    return g.withColumn("winner", F.when(F.col("pa") > F.col("pb"), "A").otherwise(arena.choice(raw, F.col("a_item"), F.lit(None).cast("string")))).select("source", "a_item", "b_item", "a_rank", "b_rank", "winner")


@query("arena_matchups", f"WITH {_TWO} SELECT source, a_item, b_item, a_rank, b_rank, winner FROM games")
def _(spark, sf):
    return _games(spark, sf)


@query("arena_wins", f"WITH {_TWO} SELECT source, count(*) AS n, count(*) FILTER (winner = 'A') AS a_wins, count(*) FILTER (winner = 'B') AS b_wins, count(*) FILTER (winner = 'tie') AS ties, round(CASE WHEN count(*) FILTER (winner <> 'tie') > 0 THEN count(*) FILTER (winner = 'B') / count(*) FILTER (winner <> 'tie') END, 6) AS b_rate FROM games GROUP BY source")
def _(spark, sf):
    return arena.wins(_games(spark, sf), ["source"])


@query("arena_rank_aligned", f"WITH {_TWO} SELECT source, a_item, b_item, a_rank AS rank FROM games WHERE a_rank = b_rank")
def _(spark, sf):
    a, b_ = _two_lists(spark, sf)
    return arena.rank_aligned(a, b_, "source", "item_id").select("source", "a_item", "b_item", F.col("a_rank").alias("rank"))


@query("blind_union", f"WITH {_TWO} SELECT item_id, md5(item_id || 'round-1') AS key FROM (SELECT item_id FROM la UNION SELECT item_id FROM lb)")
def _(spark, sf):
    a, b_ = _two_lists(spark, sf)
    return arena.blind_union(a, b_, "item_id", "round-1")


@query("rating_summary", f"WITH {b.CAND}, r AS (SELECT coalesce(source, 'unknown') AS system, popularity, row_number() OVER (PARTITION BY coalesce(source, 'unknown') ORDER BY popularity DESC) AS p FROM cand WHERE popularity IS NOT NULL) SELECT system, count(*) AS n, round(avg(popularity), 6) AS mean, round(avg(popularity) FILTER (p <= 3), 6) AS top_mean, round(median(popularity), 6) AS median FROM r GROUP BY system")
def _(spark, sf):
    rows = t.candidates(spark, sf).select(F.coalesce("source", F.lit("unknown")).alias("system"), "popularity")
    return arena.rating_summary(rows, "system", "popularity")


@query("resume_pending", "SELECT count(*) AS n, count(DISTINCT user_id) AS n_users FROM (SELECT DISTINCT user_id, answer_id FROM inter_impression WHERE answer_id IS NOT NULL AND (click_ts IS NULL OR click_ts = 0)) ANTI JOIN (SELECT DISTINCT user_id, answer_id FROM inter_impression WHERE click_ts > 0) USING (user_id, answer_id)")
def _(spark, sf):
    """Shown pairs without a decision (a click) yet."""
    rows = t.read(spark, sf, "inter_impression").where("answer_id is not null")
    todo = rows.where("click_ts is null or click_ts = 0").select("user_id", "answer_id").distinct()
    return arena.pending(todo, rows.where("click_ts > 0"), ["user_id", "answer_id"]).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("exemplar_titles", f"WITH {b.SAVED}, f AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq) AS n FROM saved) SELECT profile_id, array_to_string((list(title ORDER BY n) FILTER (title IS NOT NULL))[1:5], '|') AS titles FROM f WHERE n <= 10 GROUP BY profile_id")
def _(spark, sf):
    return rerank.exemplars(t.saved(spark, sf)).select("profile_id", F.array_join("exemplars", "|").alias("titles"))


@query("rerank_prompt", f"""WITH {b.SAVED}, f AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq) AS n FROM saved), e AS (SELECT profile_id, (list(title ORDER BY n) FILTER (title IS NOT NULL))[1:5] AS x, min_by(title, n) FILTER (title IS NOT NULL) AS title, min_by(coalesce(content, ''), n) AS body FROM f WHERE n <= 10 GROUP BY profile_id)
SELECT profile_id, md5('Saved before:' || chr(10) || array_to_string(list_transform(x, lambda t, i: '[' || i || '] ' || t), chr(10)) || chr(10) || 'Topics: ' || array_to_string(core_topics[1:8], ', ') || chr(10) || 'Styles: ' || array_to_string(coalesce(writing_style, [])[1:5], ', ') || chr(10) || 'Dislikes: ' || CASE WHEN array_to_string(coalesce(negative_tags, [])[1:5], ', ') = '' THEN 'none' ELSE array_to_string(negative_tags[1:5], ', ') END || chr(10) || 'Title: ' || title || chr(10) || 'Summary: ' || substr(body, 1, 200) || chr(10) || 'Reply with JSON: relevance_score 0-10, confidence 0-1, reasoning, matched_topics, concerns.') AS prompt
FROM e JOIN user_explicit_profile USING (profile_id)""")
def _(spark, sf):
    saved = t.saved(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("profile_id").orderBy("seq"))).where("n <= 10")
    head = saved.groupBy("profile_id").agg(F.expr("min_by(title, n) filter (where title is not null)").alias("title"), F.min_by(F.coalesce("content", F.lit("")), "n").alias("body"))
    rows = t.read(spark, sf, "user_explicit_profile").join(rerank.exemplars(t.saved(spark, sf)), "profile_id").join(head, "profile_id")
    return rows.select("profile_id", F.md5(rerank.pointwise_prompt(F.col("core_topics"), F.col("writing_style"), F.col("negative_tags"), F.col("exemplars"), F.col("title"), F.col("body"))).alias("prompt"))


@query("profile_edit", "SELECT profile_id, len(list_distinct(list_concat(core_topics, CASE WHEN profile_id IN (1, 2) THEN ['new topic', core_topics[1]] ELSE [] END))) AS n_topics, len(list_distinct(list_concat(coalesce(negative_tags, []), CASE WHEN profile_id = 3 THEN ['ads'] ELSE [] END))) AS n_negatives FROM user_explicit_profile")
def _(spark, sf):
    rows = t.read(spark, sf, "user_explicit_profile")
    out = state.edited(rows, {1: ["new topic"], 2: ["new topic", "new topic"]}, {3: ["ads"]})
    return out.select("profile_id", F.size(F.array_distinct("core_topics")).cast("bigint").alias("n_topics"), F.size(F.array_distinct(F.coalesce("negative_tags", F.array().cast("array<string>")))).cast("bigint").alias("n_negatives"))


@query("compress_passthrough", "SELECT doc_id, md5(CASE WHEN length(coalesce(text, '')) < 200 THEN text ELSE substr(text, 1, 500) || chr(10) || '...(not compressed, head only)' END) AS body FROM documents")
def _(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", F.md5(rerank.compressed(F.col("text"), F.lit(None).cast("string"))).alias("body"))


@query("typed_replies", r"""SELECT doc_id, CASE WHEN ok THEN 'read' ELSE 'neutral' END AS kind FROM (SELECT doc_id, coalesce(json_valid(regexp_extract(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '(?s)^.*</think>', ''), '```(?:json)?', '', 'g'), '(?s)(\{.*\})', 1)), false) AS ok FROM documents)""")
def _(spark, sf):
    """Real texts as replies: what is no object is neutral, with five points and little confidence."""
    f = rerank.reply_fields(F.col("text"))
    rows = t.read(spark, sf, "documents").select("doc_id", f["relevance_score"].alias("s"), f["confidence"].alias("c"))
    return rows.select("doc_id", F.when((F.col("s") == rerank.NEUTRAL) & (F.col("c") == rerank.UNSURE), "neutral").otherwise("read").alias("kind"))


@query("note_backlinks", r"WITH r AS (SELECT DISTINCT row_id, unnest(regexp_extract_all(coalesce(content, ''), '/p/([0-9]+)', 1)) AS target FROM zhihu_content) SELECT target, count(*) AS n, min(row_id) AS first_source FROM r GROUP BY target")
def _(spark, sf):
    return lenient.backlinks(lenient.references(t.read(spark, sf, "zhihu_content"), "row_id", "content", "/p/([0-9]+)"))


@query("anchor_text", f"WITH {b.CAND} SELECT s.seq AS anchor_id, md5(CASE WHEN regexp_full_match({ST('s.item_id')}, '[0-9]{{10}}') THEN CASE WHEN {ST('''coalesce(c.content, '')''')} <> '' THEN c.content ELSE 'look for depth' END ELSE {ST('''coalesce(s.item_id, '')''')} END) AS body FROM collection_item s LEFT JOIN cand c ON c.item_id = {ST('s.item_id')}")
def _(spark, sf):
    blocks = t.candidates(spark, sf).select(F.col("item_id").alias("block_id"), F.col("content").alias("body"))
    asked = t.read(spark, sf, "collection_item").select(F.col("seq").alias("anchor_id"), F.col("item_id").alias("anchor"))
    return lenient.anchors(asked, blocks, r"^\d{10}$", "look for depth").select("anchor_id", F.md5("text").alias("body"))


@query("notebook_listing", "SELECT lower(trim(source)) AS notebook, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return lenient.listing(t.read(spark, sf, "documents"), F.lower(F.trim("source")), "doc_id")


@query("posts_in_range", f"SELECT doc_id, CASE WHEN {ST('''coalesce(author_key, '')''')} = '' THEN 'Unknown' ELSE author_key END AS author_key, strftime(published_at, '%Y-%m-%d %H:%M') AS posted_text FROM documents WHERE published_at BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2023-12-31 23:59:59' AND {ST('''coalesce(text, '')''')} <> ''")
def _(spark, sf):
    return lenient.posts_between(t.read(spark, sf, "documents"), "published_at", "text", "author_key", "2023-01-01", "2023-12-31 23:59:59").select("doc_id", "author_key", "posted_text")


@query("detail_fallback", f"SELECT row_id, CASE WHEN {ST('''coalesce(content, '')''')} <> '' THEN 'content' WHEN {ST('''coalesce(excerpt, '')''')} <> '' THEN 'excerpt' ELSE 'title' END AS detail_source, md5(CASE WHEN {ST('''coalesce(content, '')''')} <> '' THEN content WHEN {ST('''coalesce(excerpt, '')''')} <> '' THEN excerpt WHEN {ST('''coalesce(title, '')''')} <> '' THEN title END) AS body FROM zhihu_content")
def _(spark, sf):
    value, where = lenient.first_filled({c: F.col(c) for c in ("content", "excerpt", "title")})
    return t.read(spark, sf, "zhihu_content").select("row_id", where.alias("detail_source"), F.md5(value).alias("body"))


@query("embedded_detail", "SELECT row_id, md5(coalesce(nullif(content, ''), excerpt)) AS body, voteup_count AS votes FROM zhihu_content WHERE id IS NOT NULL")
def _(spark, sf):
    """Each record inside the state script of a page, read back by its id; the listed excerpt stands in for a blank."""
    rows = t.read(spark, sf, "zhihu_content").where("id is not null")
    entity = F.to_json(F.struct("content", "voteup_count"))
    page = rows.select("row_id", "id", "excerpt", F.concat(F.lit('<html><script id="js-state" type="text/json">'), F.to_json(F.struct(F.struct(F.struct(F.map_from_arrays(F.array("id"), F.array(F.from_json(entity, "content string, voteup_count bigint"))).alias("answers")).alias("entities")).alias("x")).getField("x")), F.lit("</script></html>")).alias("page"))
    f = lenient.state_entity(lenient.embedded_state(F.col("page"), "js-state"), "answers", F.col("id"), ["content", "voteup_count"])
    return page.select("row_id", F.md5(F.coalesce(F.when(f["content"] != "", f["content"]), F.col("excerpt"))).alias("body"), f["voteup_count"].try_cast("bigint").alias("votes"))


@query("folder_cards", f"SELECT url, row_id, n_items, 1 AS label FROM (SELECT url, row_id, TRY_CAST(regexp_extract(replace(title, ',', ''), '([0-9]+)', 1) AS BIGINT) AS n_items, row_number() OVER (PARTITION BY url ORDER BY row_id) AS rn FROM zhihu_content WHERE url <> '' AND regexp_matches(replace(title, ',', ''), '[0-9]')) WHERE rn = 1")
def _(spark, sf):
    return lenient.folders(t.read(spark, sf, "zhihu_content").select("url", "row_id", "title"), "url", "title", "row_id").select("url", "row_id", "n_items", "label")


@query("expected_totals", "SELECT metadata['source'] AS source, max(list_max(list_transform(regexp_extract_all(replace(coalesce(content, ''), ',', ''), '([0-9]+) ?(?:小时|hours)', 1), lambda x: TRY_CAST(x AS BIGINT)))) AS expected_total FROM zhihu_content GROUP BY 1")
def _(spark, sf):
    rows = t.read(spark, sf, "zhihu_content")
    return rows.groupBy(F.col("metadata")["source"].alias("source")).agg(F.max(lenient.expected_total(F.col("content"), "([0-9]+) ?(?:小时|hours)")).alias("expected_total"))


@query("json_paths", r"SELECT row_id, len(list_distinct(regexp_extract_all(coalesce(url, '') || ' ' || coalesce(url, '') || '.json a/b.json', '([A-Za-z0-9_./-]+\.json)', 1))) AS n_paths FROM zhihu_content")
def _(spark, sf):
    log = F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")), F.lit(".json a/b.json"))
    return t.read(spark, sf, "zhihu_content").select("row_id", F.size(lenient.output_paths(log)).cast("bigint").alias("n_paths"))


@query("upsert_changes", """WITH v AS (SELECT * FROM (SELECT {key} AS key, row_id, batch_no, CASE metadata['detail_source'] WHEN 'js-initialData' THEN 3 WHEN 'dom_fallback' THEN 2 WHEN 'dom' THEN 2 WHEN 'blocked_or_summary_fallback' THEN 1 WHEN 'summary' THEN 1 ELSE 0 END AS p FROM zhihu_content)),
was AS (SELECT key, max(p) AS p FROM v WHERE batch_no < 10 GROUP BY key), now AS (SELECT key, max(p) AS p FROM v GROUP BY key)
SELECT count(*) AS total, count(*) FILTER (was.p IS NULL) AS added, count(*) FILTER (now.p > was.p) AS upgraded FROM now LEFT JOIN was USING (key)""".replace("{key}", f"CASE WHEN coalesce(id, '') <> '' AND NOT starts_with(id, 'unknown_') THEN 'id:' || id WHEN coalesce(url, '') <> '' THEN 'url:' || url WHEN {ST('''coalesce(title, '')''')} <> '' OR {ST('''coalesce(author.name, '')''')} <> '' THEN 'title_author:' || {ST('''coalesce(title, '')''')} || '::' || {ST('''coalesce(author.name, '')''')} WHEN {ST('''coalesce(excerpt, '')''')} <> '' THEN 'excerpt:' || substr({ST('''coalesce(excerpt, '')''')}, 1, 80) ELSE 'fallback:' || row_id END"))
def _(spark, sf):
    """What the batches from 10 on add to the aggregate of those before, and how many details they raise."""
    v = rec.versions(t.read(spark, sf, "zhihu_content"))
    before = rec.upsert(None, v.where("batch_no < 10"))
    return state.changes(before, rec.upsert(before, v.where("batch_no >= 10")), "key", "priority")


@query("seed_two_checkpoints", f"WITH z AS (SELECT *, {ST('''coalesce(content, '')''')} <> '' AS d FROM zhihu_content WHERE coalesce(url, '') <> '') SELECT url, arg_min(row_id, (CASE WHEN d THEN 0 ELSE 1 END, row_id)) AS row_id, bool_or(d) AS from_detail FROM z GROUP BY url")
def _(spark, sf):
    rows = t.read(spark, sf, "zhihu_content").where("coalesce(url, '') <> ''").withColumn("d", text.strip(F.coalesce("content", F.lit(""))) != "").select("url", "row_id", "d")
    return state.seeded(rows.where("d"), rows.where("not d"), "url", "row_id").select("url", "row_id", "from_detail")


@query("start_indexes", "SELECT batch_no, CASE WHEN prev <= 0 THEN 0 WHEN n > prev THEN greatest(0, prev - 30) ELSE greatest(0, n - 300) END AS start_index FROM (SELECT batch_no, count(*) AS n, coalesce(lag(count(*)) OVER (ORDER BY batch_no), 0) AS prev FROM zhihu_content GROUP BY batch_no)")
def _(spark, sf):
    by = t.read(spark, sf, "zhihu_content").groupBy("batch_no").agg(F.count("*").alias("n"))
    both = by.join(by.select((F.col("batch_no") + 1).alias("batch_no"), F.col("n").alias("prev")), "batch_no", "left")
    return both.select("batch_no", state.start_index(F.col("n"), F.coalesce("prev", F.lit(0))).cast("bigint").alias("start_index"))


@query("checkpoint_flags", "SELECT user_id, n >= 40 AS complete, n > 0 AND n >= 60 AS reusable FROM (SELECT user_id, count(*) AS n FROM inter_impression GROUP BY user_id)")
def _(spark, sf):
    """Listings that ended without a next page, of forty expected entries; sixty are asked for."""
    by = t.read(spark, sf, "inter_impression").groupBy("user_id").agg(F.count("*").alias("n"))
    done = state.is_complete(F.lit(" no_next "), F.lit(40), F.col("n"))
    return by.select("user_id", done.alias("complete"), state.is_reusable(F.lit(True), F.lit("no_next"), F.lit(40), F.col("n"), F.lit(60)).alias("reusable"))


@query("reasons_merge", f"WITH {b.SAVED} SELECT profile_id, item_id, coalesce(CASE WHEN seq % 2 = 0 THEN title END, source, 'worth a look') AS reason FROM saved")
def _(spark, sf):
    rows = t.saved(spark, sf).select("profile_id", "item_id", F.col("source").alias("reason"), "seq", "title")
    return rerank.with_reasons(rows, rows.where("seq % 2 = 0").select("profile_id", "item_id", F.col("title").alias("reason")), "worth a look").select("profile_id", "item_id", "reason")


@query("tag_fallback", f"WITH {b.CAND} SELECT u.user_id AS profile_id, count(*) AS n, 0.5::DOUBLE AS score FROM (SELECT DISTINCT user_id FROM inter_impression WHERE user_id BETWEEN 55 AND 70) u ANTI JOIN user_explicit_profile p ON p.profile_id = u.user_id, cand GROUP BY u.user_id")
def _(spark, sf):
    """Users without an explicit profile score 0.5 with every item; one number a user stands for all of them."""
    users = t.read(spark, sf, "inter_impression").where("user_id between 55 and 70").select(F.col("user_id").alias("profile_id")).distinct()
    without = users.join(t.read(spark, sf, "user_explicit_profile").select("profile_id"), "profile_id", "left_anti")
    n = t.candidates(spark, sf).agg(F.count("*").alias("n"))
    return without.join(F.broadcast(n)).select("profile_id", "n", F.lit(0.5).alias("score"))


@query("intent_query", f"WITH {b.CAND}, units AS (SELECT item_id, seq, {b.unit('embedding')} AS u FROM cand WHERE embedding IS NOT NULL), q AS (SELECT item_id AS qid, u AS qu FROM units ORDER BY seq LIMIT 1) SELECT item_id, round(list_dot_product(u, qu), 6) AS i2i FROM units, q WHERE item_id <> qid ORDER BY round(list_dot_product(u, qu), 12) DESC, seq LIMIT 5")
def _(spark, sf):
    """An ad-hoc intent as a collection of one: the vector of the first item asks for the five nearest others."""
    pool = t.candidates(spark, sf).where("embedding is not null").select("item_id", "seq", vector.unit(F.col("embedding")).alias("u"))
    one = pool.orderBy("seq").limit(1).select(F.col("item_id").alias("qid"), F.col("u").alias("qu"))
    hits = pool.join(F.broadcast(one)).where("item_id <> qid").withColumn("i2i", vector.dot(F.col("u"), F.col("qu")))
    return hits.orderBy(F.desc(F.round("i2i", 12)), "seq").limit(5).select("item_id", F.round("i2i", 6).alias("i2i"))


@query("custom_scorer", f"WITH {b.CAND}, s AS (SELECT 1::BIGINT AS profile_id, item_id, seq, popularity, coalesce(length(title), 0) AS len FROM cand WHERE popularity IS NOT NULL), lim AS (SELECT min(popularity) AS lo, max(popularity) AS hi FROM s), f AS (SELECT *, round((popularity - lo) / (hi - lo) + CASE WHEN len > 20 THEN 0.25 ELSE 0 END, 6) AS final_score FROM s, lim) SELECT item_id, final_score, row_number() OVER (ORDER BY final_score DESC, seq) AS rank FROM f ORDER BY final_score DESC, seq LIMIT 20")
def _(spark, sf):
    """A registered retriever and a custom scorer that adds a bonus to long titles."""

    class Popular:
        name = "popularity"

        def score(self, candidates: DataFrame, profiles: DataFrame) -> DataFrame:
            rows = candidates.where("popularity is not null")
            return rows.select(F.lit(1).cast("bigint").alias("profile_id"), "item_id", F.col("popularity").alias("score"))

    pool = t.candidates(spark, sf)
    long = pool.where(F.length("title") > 20).select("item_id")
    registry = extension.Registry()
    registry.add_retriever(Popular())
    registry.add_scorer("long_title", F.when(F.col("is_long"), 0.25).otherwise(0.0))
    scores = registry.scores(pool, t.read(spark, sf, "user_explicit_profile")).join(pool.select("item_id", "seq"), "item_id").join(long.withColumn("is_long", F.lit(True)), "item_id", "left")
    out = scoring.ranked(scoring.fused(scores, {"popularity": 1.0}, registry.custom), 20)
    return out.select("item_id", "final_score", "rank")


@query("frequent_topics", f"WITH {b.SAVED}, w AS (SELECT DISTINCT profile_id, item_id, unnest({b.words('title')}) AS topic FROM saved), n AS (SELECT profile_id, topic, count(*) AS n FROM w GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, topic) AS place FROM n) WHERE place <= 8")
def _(spark, sf):
    return jobs.frequent_topics(t.saved(spark, sf).select("profile_id", "item_id", "title"))


@query("impression_features", f"WITH k AS (SELECT * FROM (SELECT {ST('id')} AS answer_id, content_type, row_number() OVER (PARTITION BY {ST('id')} ORDER BY row_id) AS rn FROM zhihu_content WHERE id IS NOT NULL) WHERE rn = 1) SELECT coalesce(content_type, 'unknown') AS content_type, count(*) AS n, count(*) FILTER (click_ts > 0) AS n_clicked FROM inter_impression i LEFT JOIN k USING (answer_id) GROUP BY 1")
def _(spark, sf):
    """Impressions with the kind of the item shown; the counts of an item meet before anything is joined."""
    known = rec.first_by(t.read(spark, sf, "zhihu_content").where("id is not null").select(text.strip(F.col("id")).alias("answer_id"), "content_type", "row_id"), ["answer_id"], "row_id")
    rows = t.read(spark, sf, "inter_impression").select("answer_id", (F.col("click_ts") > 0).alias("clicked"))
    per_item = rows.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if("clicked").alias("c"))
    both = per_item.join(known.select("answer_id", "content_type"), "answer_id", "left")
    return both.groupBy(F.coalesce("content_type", F.lit("unknown")).alias("content_type")).agg(F.sum("n").alias("n"), F.sum("c").alias("n_clicked"))


@query("author_target_counts", f"SELECT author, count(*) AS n, max(row_id) AS last_row FROM (SELECT lower({ST('author.id')}) AS author, row_id, row_number() OVER (PARTITION BY lower({ST('author.id')}) ORDER BY row_id) AS rn FROM zhihu_content WHERE {ST('author.id')} <> '') WHERE rn <= 25 GROUP BY author")
def _(spark, sf):
    rows = t.read(spark, sf, "zhihu_content").select(F.lower(text.strip(F.col("author.id"))).alias("author"), "row_id").where("author <> ''")
    return jobs.first_of_each(rows, F.col("author"), "row_id", 25).groupBy("author").agg(F.count("*").alias("n"), F.max("row_id").alias("last_row"))


@query("thread_documents", """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, 0::DOUBLE AS score, 0 AS posted, r_name AS body FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, (n_nationkey % 7)::DOUBLE, n_nationkey, n_name FROM nation),
placed AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, posted DESC, id) AS place FROM nodes),
tree AS (SELECT id, body, 0 AS depth, printf('%08d', place) AS path FROM placed WHERE parent IS NULL UNION ALL SELECT p.id, p.body, t.depth + 1, t.path || '/' || printf('%08d', p.place) FROM placed p JOIN tree t ON p.parent = t.id)
SELECT substr(path, 1, 8) AS root, string_agg(repeat('  ', depth) || '- ' || body, chr(10) ORDER BY path) AS text, count(*) AS n FROM tree GROUP BY 1""")
def _(spark, sf):
    nodes = t.read(spark, sf, "region").selectExpr("concat('r', r_regionkey) AS id", "cast(null AS string) AS parent", "0D AS score", "cast(0 AS bigint) AS posted", "r_name AS body")
    nodes = nodes.unionByName(t.read(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent", "cast(n_nationkey % 7 AS double) AS score", "cast(n_nationkey AS bigint) AS posted", "n_name AS body"))
    return jobs.thread_text(nodes, "body")


@query("chunk_index_rebuild", "SELECT count(*) AS n_chunks, 0::BIGINT AS n_misses, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(range(greatest(1, ceil((length(text) - 150) / 1050.0))::BIGINT)) AS chunk_no FROM documents WHERE length(text) > 0)")
def _(spark, sf):
    """Builds the chunk index, keeps it, and builds again: the second time nothing is embedded."""
    folder = _folder(spark, "chunks")
    docs = t.read(spark, sf, "documents").select("doc_id", "text")
    none = spark.createDataFrame([], "item_id string, text_hash string, vec array<float>")
    zeros = lambda m: m.select("item_id", "text_hash", F.array_repeat(F.lit(0.0).cast("float"), 2).alias("vec"))
    jobs.chunk_index(docs, none, zeros)[0].write.parquet(f"{folder}/index")
    index, misses = jobs.chunk_index(docs, spark.read.parquet(f"{folder}/index"), zeros)
    counted = index.agg(F.count("*").alias("n_chunks"), F.countDistinct(F.substring_index("item_id", "#", 1)).alias("n_docs"))
    return counted.join(misses.agg(F.count("*").alias("n_misses"))).select("n_chunks", "n_misses", "n_docs")


@query("id_lookup", "SELECT c.seq, d.doc_id IS NOT NULL AS known FROM collection_item c LEFT JOIN documents d ON d.doc_id = c.seq")
def _(spark, sf):
    docs = t.read(spark, sf, "documents").select("doc_id")
    return t.read(spark, sf, "collection_item").select("seq").join(docs, F.col("seq") == F.col("doc_id"), "left").select("seq", F.col("doc_id").isNotNull().alias("known"))


_EUCLID = b.near("near3", "cloud", 3, 0.05).replace("AS sim,", "AS cos_, 1 / (1 + list_distance(x.u, k.vec)) AS sim,", 1)


@query("i2i_euclidean", f"WITH {b.CAND}, {b.SAVED}, {b.CLOUD}, {_EUCLID} SELECT profile_id, item_id, round(score, 5) AS i2i FROM near3")
def _(spark, sf):
    return scoring.cloud_similarity(spark, t.candidates(spark, sf), t.cloud(spark, sf), metric="euclidean").select("profile_id", "item_id", F.round("i2i", 5).alias("i2i"))


_POOLED = f"""{_SPLIT}, n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT a.item, {b.unit('e.embedding')} AS u FROM (SELECT {ST('id')} AS item, min(row_id) AS row_id FROM zhihu_content WHERE {ST('id')} <> '' GROUP BY 1) a, n JOIN embeddings e ON e.vec_id = a.row_id % n.n),
d AS (SELECT user_id, k, avg(u[k]) AS x FROM (SELECT DISTINCT user_id, item FROM parts WHERE part = 'train') JOIN v USING (item), range(1, 65) r(k) GROUP BY ALL), m AS (SELECT user_id, list(x ORDER BY k) AS mean FROM d GROUP BY user_id),
q AS (SELECT DISTINCT part, user_id, item FROM parts WHERE part = 'test'), asked AS (SELECT q.user_id, q.item, m.mean, list_dot_product(m.mean, v.u) AS s FROM q JOIN m USING (user_id) JOIN v USING (item)),
ranks AS (SELECT user_id, item, 1 + count(*) FILTER (list_dot_product(a.mean, v.u) > a.s + 1e-9) AS rank FROM asked a, v GROUP BY user_id, a.item)""".replace("SELECT user_id, item, 1 +", "SELECT a.user_id, a.item, 1 +").replace("GROUP BY user_id, a.item)", "GROUP BY a.user_id, a.item)")


@query("meanpool_metrics", f"WITH {_POOLED} SELECT count(*) AS n_asked, round(avg(CASE WHEN rank <= 50 THEN 1 ELSE 0 END), 6) AS recall_50, round(avg(CASE WHEN rank <= 500 THEN 1 ELSE 0 END), 6) AS recall_500, round(avg(1.0 / rank), 6) AS mrr FROM ranks")
def _(spark, sf):
    """Mean-pooled users against all items. The stored vectors stand in for those of the answers, dealt by row."""
    n = t.read(spark, sf, "embeddings").count()
    first = t.read(spark, sf, "zhihu_content").select(text.strip(F.col("id")).alias("item"), "row_id").where("item <> ''").groupBy("item").agg(F.min("row_id").alias("row_id"))
    vec = t.read(spark, sf, "embeddings").select("vec_id", vector.unit(F.col("embedding")).alias("vec"))
    vectors = first.join(vec, F.col("vec_id") == F.col("row_id") % n).select("item", "vec")
    parts = _parts(spark, sf)
    asked = parts.where("part = 'test'").select("user_id", "item").distinct().withColumn("ask_id", F.xxhash64("user_id", "item"))
    ranks = ev.mean_pool_ranks(parts.where("part = 'train'").select("user_id", "item").distinct(), asked, vectors)
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return ranks.agg(F.count("*").alias("n_asked"), hit(50).alias("recall_50"), hit(500).alias("recall_500"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))
