"""Queries of records, texts, evaluation and streams with their oracles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import evaluation as ev
from ..operators import recommend as r
from ..operators import records, scoring
from ..sources import sinks
from ..sources import tables as t
from ..streaming import feedback as fs
from . import base_sql as b

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of the session's shared checkpoint folder; a temporary one only where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and held.isDefined():
        base = held.get()
    if not base:
        base = tempfile.mkdtemp(prefix="sievepath-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


ST = b.strip
_TITLED = "coalesce(title, '') || chr(10) || coalesce(content, '')"
_CUT = f"substr({ST(_TITLED)}, 1, 2000)"


@query("embedding_cache_probe", f"WITH {b.CAND}, k AS (SELECT item_id, sha256({_CUT}) AS h, embedding IS NOT NULL AS cached FROM cand) SELECT cached, count(*) AS n, count(DISTINCT h) AS n_texts, min(h) AS least FROM k GROUP BY cached")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.candidates(spark, sf).select(F.sha2(text.candidate_text(F.col("title"), F.col("content")), 256).alias("h"), F.col("embedding").isNotNull().alias("cached"))
    return rows.groupBy("cached").agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_texts"), F.min("h").alias("least"))


@query("text_tokens", f"WITH w AS (SELECT row_id, unnest({b.words('title')}) AS token FROM zhihu_content) SELECT token, count(*) AS n FROM w GROUP BY token")
def _(spark, sf):
    return t.read(spark, sf, "zhihu_content").select(F.explode(text.word_tags(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _html_sql(x: str) -> str:
    x = f"regexp_replace({x}, '</p>|</li>|<br\\s?/?>|</h[1-6]>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '<li[^>]*>', '- ', 'g'), '<[^>]+>', '', 'g')"
    for name, char in text._ENTITIES:
        x = f"replace({x}, '{name}', chr({ord(char)}))"
    return ST(f"regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g')")


@query("html_to_text", f"SELECT row_id, md5({_html_sql('content')}) AS plain FROM zhihu_content WHERE content IS NOT NULL")
def _(spark, sf):
    return t.read(spark, sf, "zhihu_content").where("content is not null").select("row_id", F.md5(text.html_text(F.col("content"))).alias("plain"))


_URL = f"""CASE WHEN h = '' THEN '' WHEN h LIKE 'http://%' OR h LIKE 'https://%' THEN h WHEN h LIKE '//%' THEN 'https:' || h
 WHEN h LIKE '/zhiwen.example%' OR h LIKE 'zhiwen.example%' THEN 'https://' || regexp_replace(h, '^/+', '') WHEN h LIKE '/%' THEN 'https://zhiwen.example' || h ELSE 'https://zhiwen.example/' || h END"""


@query("url_normalise", f"SELECT row_id, {_URL} AS url FROM (SELECT row_id, {ST('''regexp_replace(coalesce(url, ''), CASE row_id % 3 WHEN 0 THEN '^https:' WHEN 1 THEN '^https:/' ELSE '^https://zhiwen.example' END, '')''')} AS h FROM zhihu_content)")
def _(spark, sf):
    u = F.coalesce("url", F.lit(""))
    k = F.col("row_id") % 3
    broken = F.when(k == 0, F.regexp_replace(u, "^https:", "")).when(k == 1, F.regexp_replace(u, "^https:/", "")).otherwise(F.regexp_replace(u, r"^https://zhiwen.example", ""))
    return t.read(spark, sf, "zhihu_content").select("row_id", text.full_url(broken, "zhiwen.example").alias("url"))


@query("id_from_url", "SELECT row_id, regexp_extract(coalesce(url, ''), '/([^/?#]+)/?(?:[?#].*)?$', 1) AS part, regexp_extract(coalesce(url, ''), '^https?://([^/?#]+)', 1) AS host FROM zhihu_content")
def _(spark, sf):
    return t.read(spark, sf, "zhihu_content").select("row_id", text.url_id(F.col("url")).alias("part"), text.url_host(F.col("url")).alias("host"))


@query("filename_sanitise", """SELECT row_id, substr(replace(regexp_replace(title, '[\\\\/*?:"<>|]', '', 'g'), ' ', '_'), 1, 100) AS name FROM zhihu_content""")
def _(spark, sf):
    return t.read(spark, sf, "zhihu_content").select("row_id", text.file_name(F.col("title")).alias("name"))


_DIG = "nullif(regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g'), '')"


@query("time_digits", f"SELECT row_id, {_DIG.format('created_time')} AS created, {_DIG.format('updated_time')} AS updated FROM zhihu_content")
def _(spark, sf):
    plain = lambda c: text.time_digits(F.col(c))
    raw = lambda c: F.when(plain(c).isNotNull(), F.regexp_replace(c, "[^0-9]", ""))
    return t.read(spark, sf, "zhihu_content").select("row_id", raw("created_time").alias("created"), raw("updated_time").alias("updated"))


@query("first_count", "SELECT row_id, coalesce(TRY_CAST(nullif(regexp_extract(replace(coalesce(title, ''), ',', ''), '([0-9]+)', 1), '') AS BIGINT), 0) AS n FROM zhihu_content")
def _(spark, sf):
    return t.read(spark, sf, "zhihu_content").select("row_id", text.first_count(F.col("title")).alias("n"))


@query("llm_json_cleanup", """SELECT row_id, TRY_CAST(json_extract_string(j, '$.votes') AS BIGINT) AS votes FROM (SELECT row_id, '{"votes": ' || coalesce(voteup_count, 0) || '}' AS j FROM zhihu_content)""")
def _(spark, sf):
    votes = F.concat(F.lit('{"votes": '), F.coalesce("voteup_count", F.lit(0)).cast("string"), F.lit("}"))
    reply = F.concat(F.lit("<think>{a}</think> Sure:\n```json\n"), votes, F.lit("\n```"))
    return t.read(spark, sf, "zhihu_content").select("row_id", F.get_json_object(text.reply_json(reply), "$.votes").cast("bigint").alias("votes"))


@query("frontmatter_parse", r"""SELECT doc_id, nullif(regexp_extract(block, '(?m)^title:[ \t]*(.*?)[ \t\r]*$', 1), '') AS title, len(list_filter(string_split(regexp_extract(block, '(?m)^tags:[ \t]*\[(.*?)\]', 1), ','), lambda x: trim(x) <> '')) AS n_tags
FROM (SELECT doc_id, regexp_extract(text, '(?s)^---[ \t\r]*\n(.*?)\n---[ \t\r]*(?:\n|$)', 1) AS block FROM documents) WHERE block <> ''""")
def _(spark, sf):
    rows = t.read(spark, sf, "documents").select("doc_id", text.front_matter(F.col("text")).alias("block")).where("block <> ''")
    return rows.select("doc_id", F.nullif(text.front_value(F.col("block"), "title"), F.lit("")).alias("title"), F.size(text.front_list(F.col("block"), "tags")).cast("bigint").alias("n_tags"))


_KEY = f"""CASE WHEN coalesce(id, '') <> '' AND id NOT LIKE 'unknown\\_%' ESCAPE '\\' THEN 'id:' || id WHEN coalesce(url, '') <> '' THEN 'url:' || url
 WHEN {ST("coalesce(title, '')")} <> '' OR {ST("coalesce(author.name, '')")} <> '' THEN 'title_author:' || {ST("coalesce(title, '')")} || '::' || {ST("coalesce(author.name, '')")}
 WHEN {ST("coalesce(excerpt, '')")} <> '' THEN 'excerpt:' || substr({ST("coalesce(excerpt, '')")}, 1, 80) ELSE 'fallback:' || row_id END"""


@query("dedupe_key_cascade", f"SELECT key, count(*) AS n FROM (SELECT {_KEY} AS key FROM zhihu_content) GROUP BY key")
def _(spark, sf):
    return records.versions(t.read(spark, sf, "zhihu_content")).groupBy("key").agg(F.count("*").alias("n"))


_VERSIONS = f"""v AS (SELECT row_id, batch_no, {_KEY} AS key, CASE metadata['detail_source'] WHEN 'js-initialData' THEN 3 WHEN 'dom_fallback' THEN 2 WHEN 'dom' THEN 2 WHEN 'blocked_or_summary_fallback' THEN 1 WHEN 'summary' THEN 1 ELSE 0 END AS priority,
 length(coalesce(content, '')) AS len, coalesce({_DIG.format('updated_time')}::HUGEINT, {_DIG.format('created_time')}::HUGEINT, 0) AS stamp FROM zhihu_content)"""
_BEST = f"WITH {_VERSIONS} SELECT key, row_id, priority::INT AS priority, len AS length FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, len DESC, stamp DESC, row_id DESC) AS rn FROM v) WHERE rn = 1"


@query("upsert_best_version", _BEST)
def _(spark, sf):
    best = records.best_version(records.versions(t.read(spark, sf, "zhihu_content")), "key", "row_id")
    return best.select("key", "row_id", "priority", F.col("length").cast("bigint").alias("length"))


@query("union_answers_articles", "SELECT content_type, count(*) AS n, sum(voteup_count)::BIGINT AS votes FROM zhihu_content WHERE content_type IN ('answer', 'article') GROUP BY content_type")
def _(spark, sf):
    rows = t.read(spark, sf, "zhihu_content")
    both = rows.where("content_type = 'answer'").unionByName(rows.where("content_type = 'article'"), allowMissingColumns=True)
    return both.groupBy("content_type").agg(F.count("*").alias("n"), F.sum("voteup_count").alias("votes"))


@query("quality_report", f"""SELECT count(*) AS n, round(avg((url LIKE 'https://%')::INT), 4) AS url_share, round(avg((coalesce(length({ST('content')}), 0) >= 50)::INT), 4) AS long_share,
 round(avg(({ST("coalesce(id, '')")} <> '')::INT), 4) AS id_share, count(*) FILTER (metadata['detail_source'] = 'js-initialData') AS n_full FROM zhihu_content""")
def _(spark, sf):
    share = lambda c: F.coalesce(F.round(F.avg(c.cast("int")), 4), F.lit(0.0))
    return t.read(spark, sf, "zhihu_content").agg(
        F.count("*").alias("n"), share(F.col("url").startswith("https://")).alias("url_share"), share(F.coalesce(F.length(text.strip(F.col("content"))), F.lit(0)) >= 50).alias("long_share"),
        share(text.strip(F.coalesce("id", F.lit(""))) != "").alias("id_share"), F.count_if(F.col("metadata")["detail_source"] == "js-initialData").alias("n_full"),
    )


@query("type_counts", "SELECT content_type, metadata['label'] AS label, count(*) AS n FROM zhihu_content GROUP BY ALL")
def _(spark, sf):
    return t.read(spark, sf, "zhihu_content").groupBy("content_type", F.col("metadata")["label"].alias("label")).agg(F.count("*").alias("n"))


@query("input_summary", f"""WITH {b.CAND}, s AS (SELECT {ST("coalesce(item_id, '')")} AS i FROM collection_item), c AS (SELECT {ST("coalesce(item_id, '')")} AS i FROM candidate_item),
 su AS (SELECT DISTINCT i FROM s WHERE i <> ''), cu AS (SELECT DISTINCT i FROM c WHERE i <> '')
SELECT (SELECT count(*) FROM s) AS collection_input, (SELECT count(*) FROM su) AS collection_unique, (SELECT count(*) FROM s) - (SELECT count(*) FROM su) AS collection_duplicate,
 (SELECT count(*) FROM c) AS candidate_input, (SELECT count(*) FROM cu) AS candidate_unique, (SELECT count(*) FROM c) - (SELECT count(*) FROM cu) AS candidate_duplicate,
 (SELECT count(*) FROM cu WHERE i IN (SELECT i FROM su)) AS overlap, (SELECT count(*) FROM cu WHERE i NOT IN (SELECT i FROM su)) AS candidate_final""")
def _(spark, sf):
    key = lambda n: t.read(spark, sf, n).select(text.strip(F.coalesce("item_id", F.lit(""))).alias("i"))
    mark = key("collection_item").groupBy("i").agg(F.count("*").alias("s")).join(key("candidate_item").groupBy("i").agg(F.count("*").alias("c")), "i", "full")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    has = lambda c: (F.col(c).isNotNull() & (F.col("i") != "")).cast("bigint")
    return mark.agg(
        z("s").alias("collection_input"), z(has("s")).alias("collection_unique"), (z("s") - z(has("s"))).alias("collection_duplicate"), z("c").alias("candidate_input"), z(has("c")).alias("candidate_unique"), (z("c") - z(has("c"))).alias("candidate_duplicate"),
        z(has("s") * has("c")).alias("overlap"), (z(has("c")) - z(has("s") * has("c"))).alias("candidate_final"),
    )


@query("profile_summary", f"""SELECT p.profile_id, core_topics[1:10] AS topics, coalesce(negative_tags, [])[1:5] AS negatives, len(core_topics) AS n_topics, map_keys(custom_tags) AS custom, coalesce(n, 0) AS n_saved
FROM user_explicit_profile p LEFT JOIN (SELECT profile_id, count(*) AS n FROM collection_item GROUP BY profile_id) c USING (profile_id)""")
def _(spark, sf):
    n = t.read(spark, sf, "collection_item").groupBy("profile_id").agg(F.count("*").alias("n"))
    rows = t.read(spark, sf, "user_explicit_profile").join(n, "profile_id", "left")
    return rows.select("profile_id", F.slice("core_topics", 1, 10).alias("topics"), F.slice(F.coalesce("negative_tags", F.array().cast("array<string>")), 1, 5).alias("negatives"), F.size("core_topics").cast("bigint").alias("n_topics"), F.map_keys("custom_tags").alias("custom"), F.coalesce("n", F.lit(0)).alias("n_saved"))


@query("result_flatten", "SELECT row_id, author.id AS author_id, author.name AS author_name, author.headline AS author_headline, author.follower_count AS author_follower_count, len(tags) AS n_tags FROM zhihu_content")
def _(spark, sf):
    rows = t.read(spark, sf, "zhihu_content").select("row_id", "author", F.when(F.col("tags").isNotNull(), F.size("tags").cast("bigint")).alias("n_tags"))
    return records.flat(rows)


@query("popularity_log", "SELECT row_id, round(ln(1 + coalesce(voteup_count, 0) + 2 * coalesce(comment_count, 0)), 6) AS popularity FROM zhihu_content WHERE coalesce(voteup_count, 0) >= 0")
def _(spark, sf):
    rows = t.read(spark, sf, "zhihu_content").where(F.coalesce("voteup_count", F.lit(0)) >= 0)
    return rows.select("row_id", F.round(scoring.popularity_of(F.col("voteup_count"), F.col("comment_count")), 6).alias("popularity"))


_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, 0.0::DOUBLE AS score, 0 AS posted FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 7, n_nationkey FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_acctbal::DOUBLE, s_suppkey FROM supplier),
placed AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, posted DESC, id) AS place FROM nodes)"""


@query("thread_tree", f"WITH RECURSIVE {_NODES}, tree AS (SELECT id, 0 AS depth, printf('%08d', place) AS path FROM placed WHERE parent IS NULL UNION ALL SELECT p.id, t.depth + 1, t.path || '/' || printf('%08d', p.place) FROM placed p JOIN tree t ON p.parent = t.id) SELECT id, depth, path FROM tree")
def _(spark, sf):
    nodes = t.read(spark, sf, "region").selectExpr("concat('r', r_regionkey) AS id", "cast(null AS string) AS parent", "0D AS score", "cast(0 AS bigint) AS posted")
    nodes = nodes.unionByName(t.read(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent", "cast(n_nationkey % 7 AS double) AS score", "cast(n_nationkey AS bigint) AS posted"))
    nodes = nodes.unionByName(t.read(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) AS id", "concat('n', s_nationkey) AS parent", "cast(s_acctbal AS double) AS score", "cast(s_suppkey AS bigint) AS posted"))
    return records.tree(nodes).select("id", "depth", "path")


@query("chunk_documents", "SELECT doc_id, chunk_no, chunk_no * 1050 + 1 AS start_pos, md5(substr(text, (chunk_no * 1050 + 1)::BIGINT, 1200)) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 150) / 1050.0))::BIGINT)) AS chunk_no FROM documents WHERE length(text) > 0)")
def _(spark, sf):
    return records.chunks(t.read(spark, sf, "documents"), "doc_id", "text").withColumn("chunk", F.md5("chunk"))


@query("feed_topn_per_source", "SELECT s AS source, doc_id, rn AS place FROM (SELECT lower(trim(source)) AS s, doc_id, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def _(spark, sf):
    rows = t.read(spark, sf, "documents").select(F.lower(F.trim("source")).alias("source"), "doc_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint")).where("place <= 3")


@query("recent_items", "SELECT doc_id, source FROM documents WHERE published_at IS NOT NULL ORDER BY published_at DESC, doc_id LIMIT 30")
def _(spark, sf):
    return t.read(spark, sf, "documents").where("published_at is not null").orderBy(F.desc("published_at"), "doc_id").limit(30).select("doc_id", "source")


@query("seeded_sample")
def _(spark, sf):
    """Thirty documents by a seeded hash: the same ones in every run and for every partitioning."""
    return t.read(spark, sf, "documents").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(30).select("doc_id")


_BLOCKS = "SELECT doc_id AS id, text AS markdown, CASE lower(trim(source)) WHEN 'note_block' THEN 'p' ELSE 'd' END AS type, published_at AS updated FROM documents"


@query("notes_sql_passthrough", f"SELECT type, count(*) AS n, count(updated) AS n_dated FROM ({_BLOCKS}) WHERE markdown <> '' GROUP BY type")
def _(spark, sf):
    t.read(spark, sf, "documents").createOrReplaceTempView("note_documents")
    spark.sql(_BLOCKS.replace("FROM documents", "FROM note_documents")).createOrReplaceTempView("blocks")
    return spark.sql("SELECT type, count(*) AS n, count(updated) AS n_dated FROM blocks WHERE markdown <> '' GROUP BY type")


@query("block_search", "SELECT doc_id, lower(trim(source)) AS source FROM documents WHERE text LIKE '%memory leak%' AND lower(trim(source)) IN ('answer', 'forum_post', 'wiki_note')")
def _(spark, sf):
    kind = F.lower(F.trim("source"))
    return t.read(spark, sf, "documents").where(F.col("text").contains("memory leak") & kind.isin("answer", "forum_post", "wiki_note")).select("doc_id", kind.alias("source"))


@query("title_lookup", f"WITH {b.CAND}, ids AS (SELECT title, max_by(item_id, seq) AS item_id FROM cand WHERE title IS NOT NULL GROUP BY title) SELECT c.seq, coalesce(i.item_id, 'unknown_id') AS found FROM collection_item c LEFT JOIN ids i ON c.title = i.title")
def _(spark, sf):
    ids = t.candidates(spark, sf).where("title is not null").groupBy("title").agg(F.max_by("item_id", "seq").alias("item_id"))
    return t.read(spark, sf, "collection_item").select("seq", "title").join(ids, "title", "left").select("seq", F.coalesce("item_id", F.lit("unknown_id")).alias("found"))


_PRESENT = f"""p AS (SELECT s.profile_id, s.seq, (c.item_id IS NOT NULL)::INT AS present FROM saved s LEFT JOIN (SELECT item_id FROM cand) c USING (item_id))"""


@query("contiguous_prefix", f"WITH {b.CAND}, {b.SAVED}, {_PRESENT} SELECT profile_id, sum(ok)::BIGINT AS prefix, count(*) AS n FROM (SELECT profile_id, min(present) OVER (PARTITION BY profile_id ORDER BY seq) AS ok FROM p) GROUP BY profile_id")
def _(spark, sf):
    marked = t.saved(spark, sf).select("profile_id", "seq", "item_id").join(t.candidates(spark, sf).select("item_id", F.lit(1).alias("present")), "item_id", "left")
    return records.gap_free(marked.withColumn("present", F.coalesce("present", F.lit(0))), "profile_id", "seq")


_S = "CASE WHEN {0} > 100000000000 THEN {0} // 1000 ELSE {0} END"
_CLICKS = f"""c AS (SELECT DISTINCT user_id, answer_id AS item, shown_at, clicked_at FROM (SELECT user_id, answer_id, {_S.format('impression_ts')} AS shown_at, {_S.format('click_ts')} AS clicked_at FROM inter_impression WHERE click_ts > 0 AND impression_ts IS NOT NULL AND answer_id IS NOT NULL) WHERE clicked_at >= shown_at)"""
_SPLIT = f"""{_CLICKS}, o AS (SELECT clicked_at, row_number() OVER (ORDER BY clicked_at) - 1 AS rn, count(*) OVER () AS n FROM c),
e AS (SELECT min(clicked_at) FILTER (rn >= floor(n * 0.8)) AS e1, min(clicked_at) FILTER (rn >= floor(n * 0.9)) AS e2 FROM o),
parts AS (SELECT c.*, CASE WHEN clicked_at < e1 THEN 'train' WHEN clicked_at < e2 THEN 'valid' ELSE 'test' END AS part FROM c, e)"""


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    clicked = ev.clicks(t.read(spark, sf, "inter_impression"))
    return ev.split(clicked, ev.split_times(clicked))


@query("time_split", f"WITH {_SPLIT} SELECT part, count(*) AS n, min(clicked_at) AS first_click, max(clicked_at) AS last_click FROM parts GROUP BY part")
def _(spark, sf):
    return _parts(spark, sf).groupBy("part").agg(F.count("*").alias("n"), F.min("clicked_at").alias("first_click"), F.max("clicked_at").alias("last_click"))


@query("click_history20", f"WITH {_CLICKS} SELECT user_id, item, shown_at, clicked_at, md5(array_to_string(list(item) OVER (PARTITION BY user_id ORDER BY clicked_at, shown_at, item ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), ',')) AS history FROM c")
def _(spark, sf):
    rows = ev.histories(ev.clicks(t.read(spark, sf, "inter_impression")))
    return rows.withColumn("history", F.when(F.size("history") > 0, F.md5(F.array_join("history", ","))))


@query("hard_negatives", f"""WITH {_CLICKS}, s AS (SELECT DISTINCT user_id, answer_id AS other, {_S.format('impression_ts')} AS at FROM inter_impression WHERE impression_ts IS NOT NULL AND answer_id IS NOT NULL),
never AS (SELECT s.* FROM s ANTI JOIN (SELECT DISTINCT user_id, item AS other FROM c) k USING (user_id, other))
SELECT c.user_id, c.item, c.shown_at, c.clicked_at, count(DISTINCT other) AS n_negatives FROM c JOIN never n ON n.user_id = c.user_id AND abs(n.at - c.shown_at) <= 600 GROUP BY ALL""")
def _(spark, sf):
    shown = t.read(spark, sf, "inter_impression")
    return ev.hard_negatives(shown, ev.clicks(shown))


@query("popularity_recall", f"""WITH {_SPLIT}, top AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM parts WHERE part = 'train' GROUP BY item QUALIFY rank <= 50)
SELECT part, count(*) AS n_clicks, round(avg((coalesce(rank, 99) <= 10)::INT), 6) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10,
 round(avg((coalesce(rank, 99) <= 50)::INT), 6) AS recall_50, round(avg(CASE WHEN rank <= 50 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_50, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM parts LEFT JOIN top USING (item) WHERE part <> 'train' GROUP BY part""")
def _(spark, sf):
    return ev.popular_recall(_parts(spark, sf))


_TOP2 = f"WITH {b.fused(scoring.PRESETS['balanced'])}, b2 AS (SELECT profile_id, {b.bounds(scoring.PRESETS['precision'])} FROM scores GROUP BY profile_id), f2 AS (SELECT s.profile_id, s.item_id, s.seq, round({' + '.join(f'{w}::DOUBLE * ({b.norm(c)})' for c, w in scoring.PRESETS['precision'].items())}, 6) AS final_score FROM scores s JOIN b2 b USING (profile_id)), la AS (SELECT * FROM (SELECT profile_id, item_id, row_number() OVER (PARTITION BY profile_id ORDER BY final_score DESC, seq) AS ra FROM fused) WHERE ra <= 20), lb AS (SELECT * FROM (SELECT profile_id, item_id, row_number() OVER (PARTITION BY profile_id ORDER BY final_score DESC, seq) AS rb FROM f2) WHERE rb <= 20)"


@query("topk_overlap", f"{_TOP2} SELECT profile_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS n_shared, round(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*), 6) AS jaccard, round(avg(abs(ra - rb)), 6) AS rank_gap, bool_or(coalesce(ra = 1 AND rb = 1, false)) AS same_first FROM la FULL JOIN lb USING (profile_id, item_id) GROUP BY profile_id")
def _(spark, sf):
    scores = r.component_scores(spark, sf)
    lists = [scoring.ranked(scoring.fused(scores, scoring.PRESETS[p]), 20) for p in ("balanced", "precision")]
    return ev.overlap(*lists)


_GAMES = "games AS (SELECT o_orderkey AS pair_id, 'arena-' || (o_custkey % 5) AS arena, o_orderdate AS at, 'p' || (o_custkey % 11) AS a, 'p' || (o_orderkey % 13) AS b, CASE WHEN o_totalprice::DOUBLE > 160000 THEN 'A' WHEN o_totalprice::DOUBLE > 150000 THEN 'tie' ELSE 'B' END AS winner, o_orderkey % 7 AS k FROM orders)"


def _games(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice").cast("double")
    return t.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pair_id"), F.concat(F.lit("arena-"), F.col("o_custkey") % 5).alias("arena"), F.col("o_orderdate").alias("at"), F.concat(F.lit("p"), F.col("o_custkey") % 11).alias("a"),
        F.concat(F.lit("p"), F.col("o_orderkey") % 13).alias("b"), F.when(price > 160000, "A").when(price > 150000, "tie").otherwise("B").alias("winner"), (F.col("o_orderkey") % 7).alias("k"),
    )


@query("pairwise_report", f"WITH {_GAMES} SELECT a AS left_side, b AS right_side, count(*) FILTER (winner = 'A') AS left_wins, count(*) FILTER (winner = 'B') AS right_wins, count(*) FILTER (winner = 'tie') AS ties, round(count(*) FILTER (winner = 'B') / nullif(count(*) FILTER (winner <> 'tie'), 0), 6) AS right_rate FROM games GROUP BY a, b")
def _(spark, sf):
    return ev.win_report(_games(spark, sf).select(F.col("a").alias("left_side"), F.col("b").alias("right_side"), "winner"))


@query("order_flip", f"WITH {_GAMES} SELECT CASE WHEN k = 3 AND winner <> 'tie' THEN 'unstable' ELSE winner END AS verdict, count(*) AS n FROM games GROUP BY 1")
def _(spark, sf):
    g = _games(spark, sf)
    back = g.withColumn("winner", F.when((F.col("k") == 3) & (F.col("winner") == "A"), "B").when((F.col("k") == 3) & (F.col("winner") == "B"), "A").otherwise(F.col("winner")))
    return ev.order_flips(g, back).groupBy("verdict").agg(F.count("*").alias("n"))


_TRIALS = "trials AS (SELECT p_partkey AS item_id, k AS trial, row_number() OVER (PARTITION BY k ORDER BY p_retailprice::DOUBLE * (1 + ((p_partkey * (k + 3)) % 17) / 100.0) DESC, p_partkey) AS rank FROM part, range(3) r(k))"


@query("rank_stability", f"WITH {_TRIALS} SELECT item_id, count(*) AS n_trials, round(stddev_pop(rank), 6) AS rank_std, min(rank) AS best, max(rank) AS worst FROM trials GROUP BY item_id")
def _(spark, sf):
    rows = t.read(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_retailprice").cast("double").alias("price"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("trial"))
    noisy = rows.withColumn("score", F.col("price") * (1 + ((F.col("item_id") * (F.col("trial") + 3)) % 17) / F.lit(100.0)))
    rank = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "item_id")).cast("bigint")
    return ev.rank_stability(noisy.select("item_id", "trial", rank.alias("rank")))


@query("glicko2_ratings")
def _(spark, sf):
    g = _games(spark, sf).where("a <> b")
    return ev.glicko(g.select("arena", F.col("pair_id").alias("game"), F.col("at").cast("string").alias("at"), "a", "b", F.when(F.col("winner") == "A", 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0).alias("score")))


@query("kmeans_clusters")
def _(spark, sf):
    return ev.clusters(t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k=10).groupBy("cluster").agg(F.count("*").alias("n"))


@query("mock_embed")
def _(spark, sf):
    return ev.mock_vectors(t.read(spark, sf, "collection_item"), "seq", "title")


_U = b.unit("embedding")


@query("label_centroids", f"WITH u AS (SELECT label, {_U} AS u FROM embeddings) SELECT label, d, round(avg(u[d]), 6) AS mean FROM u, range(1, 65) r(d) GROUP BY label, d")
def _(spark, sf):
    """Mean pooling of vectors, one row a dimension."""
    each = t.read(spark, sf, "embeddings").select("label", F.posexplode(vector.unit(F.col("embedding"))).alias("d", "x"))
    return each.groupBy("label", (F.col("d") + 1).cast("bigint").alias("d")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query("vector_metrics", f"WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_U} AS u FROM embeddings), q AS (SELECT e AS qe, u AS qu FROM u WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(u, qu), 6) AS cosine, round(list_dot_product(e, qe), 6) AS dot, round(1 / (1 + list_distance(u, qu)), 6) AS euclid FROM u, q")
def _(spark, sf):
    rows = t.read(spark, sf, "embeddings")
    q = rows.where("vec_id = 0").select("embedding").first()[0]
    one = F.array(*[F.lit(float(x)) for x in q])
    e = F.col("embedding")
    return rows.select("vec_id", F.round(vector.cosine(e, one), 6).alias("cosine"), F.round(vector.dot(e, one), 6).alias("dot"), F.round(vector.euclidean_similarity(e, one), 6).alias("euclid"))


@query("briefing_feedback_parse", f"WITH {b.CAND} SELECT 1::BIGINT AS profile_id, item_id, seq % 2 = 0 AS liked, seq % 3 = 0 AS disliked, seq % 5 = 0 AS topic, false AS shallow, false AS source, seq % 7 = 0 AS seen FROM cand WHERE seq % 2 = 0 OR seq % 3 = 0")
def _(spark, sf):
    """Writes a briefing entry for every item, ticks boxes by its order, and reads them back."""
    rows = t.candidates(spark, sf).select(F.lit(1).cast("bigint").alias("profile_id"), F.col("seq").alias("rank"), "item_id", "title")
    one = sinks.briefing(rows.withColumn("profile_id", F.col("rank")))
    tick = lambda c, name, n: F.when(F.col("profile_id") % n == 0, F.replace(c, F.lit(f"[ ] {name}"), F.lit(f"[x] {name}"))).otherwise(c)
    m = F.col("markdown")
    for name, n in (("like", 2), ("dislike", 3), ("topic", 5), ("seen", 7)):
        m = tick(m, name, n)
    read = sinks.briefing_feedback(one.withColumn("markdown", m))
    return read.withColumn("profile_id", F.lit(1).cast("bigint"))


@query("stream_upsert", _BEST)
def _(spark, sf):
    folder = _folder(spark, "upsert")
    versions = records.versions(t.read(spark, sf, "zhihu_content"))
    versions.repartitionByRange(4, "batch_no", "row_id").write.parquet(f"{folder}/feed")
    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
    out = fs.run_upsert(spark, stream, folder)
    return out.select("key", "row_id", "priority", F.col("length").cast("bigint").alias("length"))


@query("stream_feedback_prefs", f"WITH {b.PREFS} SELECT * FROM prefs WHERE kind <> 'facet'")
def _(spark, sf):
    folder = _folder(spark, "prefs")
    s = r.signals(spark, sf).select("profile_id", F.explode(F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")), F.struct(F.lit("author").alias("kind"), F.col("author").alias("key")))).alias("k"), "delta").select("profile_id", "k.*", "delta").where("key <> ''")
    s.write.parquet(f"{folder}/events")
    return fs.run_preferences(spark, spark.readStream.schema(s.schema).parquet(f"{folder}/events"), folder)


@query("stream_window_counts", "SELECT event_type, count(*) AS n, count(DISTINCT time_bucket(INTERVAL 1 HOUR, ts)) AS n_windows FROM events GROUP BY event_type")
def _(spark, sf):
    """An extension: hourly event counts, the same function that runs on a stream."""
    rows = fs.window_counts(t.read(spark, sf, "events"), "ts", "1 hour", "10 minutes", "event_type")
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("n_windows"))
