"""Shared common table expressions of the oracles."""

STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


def unit(x: str) -> str:
    return f"list_transform({x}::DOUBLE[], lambda v: v / (sqrt(list_dot_product({x}::DOUBLE[], {x}::DOUBLE[])) + 1e-8))"


def tags(x: str) -> str:
    return f"list_filter(list_transform(coalesce({x}, []::VARCHAR[]), lambda g: lower({strip('g')})), lambda g: g IS NOT NULL AND g <> '')"


def words(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda g: regexp_full_match(g, '[一-龥a-z]{{2,}}')))"


CAND = f"""
cand AS (SELECT * FROM (
  SELECT {strip('item_id')} AS item_id, min(seq) OVER (PARTITION BY {strip('item_id')}) AS seq, title, content, tags, source, popularity, metadata,
         CASE WHEN len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v))) AND list_bool_or(list_transform(embedding, lambda v: v <> 0)) THEN embedding END AS embedding,
         row_number() OVER (PARTITION BY {strip('item_id')} ORDER BY seq DESC) AS rn
  FROM candidate_item WHERE {strip('item_id')} <> '') WHERE rn = 1)"""

SAVED = f"""
saved AS (SELECT * FROM (
  SELECT * REPLACE ({strip('item_id')} AS item_id), row_number() OVER (PARTITION BY profile_id, {strip('item_id')} ORDER BY seq) AS rn
  FROM collection_item WHERE {strip('item_id')} <> '') WHERE rn = 1)"""

CLOUD = f"""
first50 AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq) AS n FROM saved),
cloud AS (SELECT s.profile_id, row_number() OVER (PARTITION BY s.profile_id ORDER BY s.seq) - 1 AS pos, count(*) OVER (PARTITION BY s.profile_id) AS size, {unit('c.embedding')} AS vec
  FROM first50 s JOIN cand c ON s.item_id = c.item_id WHERE s.n <= 50 AND c.embedding IS NOT NULL),
units AS (SELECT item_id, seq, {unit('embedding')} AS u FROM cand WHERE embedding IS NOT NULL)"""

OPEN = """
open AS (SELECT p.profile_id, c.item_id, c.seq FROM (SELECT DISTINCT profile_id FROM user_explicit_profile) p, cand c
  WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.profile_id = p.profile_id AND s.item_id = c.item_id))"""


def near(name: str, cloud: str, top: int, decay: float) -> str:
    return f"""
{name} AS (SELECT profile_id, item_id, sum(sim * w) / sum(w) AS score FROM (
  SELECT k.profile_id, x.item_id, list_dot_product(x.u, k.vec) AS sim, exp(-{decay}::DOUBLE * (k.size - 1 - k.pos)) AS w,
         row_number() OVER (PARTITION BY k.profile_id, x.item_id ORDER BY round(list_dot_product(x.u, k.vec), 12) DESC, k.pos) AS rn
  FROM units x, {cloud} k) WHERE rn <= {top} GROUP BY profile_id, item_id)"""


PTAGS = f"""
ptags AS (SELECT profile_id, tag, kind, count(*) AS n FROM (
  SELECT profile_id, unnest({tags('core_topics')}) AS tag, 'topic' AS kind FROM user_explicit_profile
  UNION ALL SELECT profile_id, unnest({tags('negative_tags')}) AS tag, 'negative' FROM user_explicit_profile) GROUP BY ALL),
itags AS (SELECT item_id, unnest(list_distinct(list_concat({tags('tags')}, {words('title')}, {words('content')}))) AS tag FROM cand),
tagged AS (SELECT profile_id, item_id, sum(CASE WHEN kind = 'topic' THEN n ELSE 0 END) AS hits, sum(CASE WHEN kind = 'negative' THEN n ELSE 0 END) AS misses
  FROM itags JOIN ptags USING (tag) GROUP BY profile_id, item_id)"""

INTENT = f"""
chosen AS (SELECT DISTINCT p.profile_id, i.item_id FROM (SELECT item_id, unnest({tags('tags')}) AS tag FROM cand WHERE embedding IS NOT NULL) i JOIN ptags p ON p.tag = i.tag AND p.kind = 'topic'),
dims AS (SELECT profile_id, d, avg(u[d]) AS x FROM chosen JOIN units USING (item_id), range(1, 65) r(d) GROUP BY profile_id, d),
means AS (SELECT profile_id, list(x ORDER BY d) AS m FROM dims GROUP BY profile_id),
intent AS (SELECT profile_id, 0 AS pos, 1 AS size, {unit('m')} AS vec FROM means)"""

_SEC = "CASE WHEN {0} > 100000000000 THEN {0} // 1000 ELSE {0} END"
PREFS = f"""
shown AS (SELECT DISTINCT * FROM inter_impression WHERE click_ts > 0 AND user_id IN (SELECT profile_id FROM user_explicit_profile)),
known AS (SELECT * FROM (SELECT {strip('id')} AS answer_id, metadata['source'] AS source, lower({strip('author.id')}) AS author, row_number() OVER (PARTITION BY {strip('id')} ORDER BY row_id) AS rn FROM zhihu_content WHERE id IS NOT NULL) WHERE rn = 1),
signals AS (SELECT user_id AS profile_id, s.answer_id, source, author, CASE WHEN {_SEC.format('click_ts')} < {_SEC.format('impression_ts')} THEN -2 ELSE 1 END AS delta FROM shown s JOIN known k ON s.answer_id = k.answer_id),
prefs AS (SELECT profile_id, 'source' AS kind, source AS key, sum(delta)::BIGINT AS score FROM signals WHERE source <> '' GROUP BY ALL
  UNION ALL SELECT profile_id, 'author', author, sum(delta)::BIGINT FROM signals WHERE author <> '' GROUP BY ALL
  UNION ALL SELECT profile_id, 'facet', unnest(list_distinct(list_concat({tags('content_depth')}, {tags('writing_style')}))), 1 FROM user_explicit_profile)"""

SCORES = """
scores AS (SELECT o.profile_id, o.item_id, o.seq, coalesce(n.score, 0) AS i2i, CASE WHEN coalesce(g.misses, 0) > 0 THEN 0 ELSE coalesce(g.hits, 0)::DOUBLE END AS tag,
    greatest(0, coalesce(m.score, 0)) AS semantic, c.popularity, coalesce(p1.score, 0)::DOUBLE + coalesce(p2.score, 0)::DOUBLE AS source, coalesce(p3.score, 0)::DOUBLE AS facet,
    coalesce(TRY_CAST(c.metadata['quality'] AS DOUBLE) / 5, 0.6)::DOUBLE AS quality
  FROM open o JOIN cand c USING (item_id) LEFT JOIN near3 n ON n.profile_id = o.profile_id AND n.item_id = o.item_id LEFT JOIN meant m ON m.profile_id = o.profile_id AND m.item_id = o.item_id
  LEFT JOIN tagged g ON g.profile_id = o.profile_id AND g.item_id = o.item_id
  LEFT JOIN prefs p1 ON p1.kind = 'source' AND p1.profile_id = o.profile_id AND p1.key = coalesce(c.source, 'unknown')
  LEFT JOIN prefs p2 ON p2.kind = 'author' AND p2.profile_id = o.profile_id AND p2.key = lower(coalesce(c.metadata['author'], 'unknown'))
  LEFT JOIN prefs p3 ON p3.kind = 'facet' AND p3.profile_id = o.profile_id AND p3.key = coalesce(c.metadata['depth'], 'unknown'))"""

ALL = ", ".join([CAND, SAVED, CLOUD, OPEN, near("near3", "cloud", 3, 0.05), PTAGS, INTENT, near("meant", "intent", 1, 0.05), PREFS, SCORES])


def norm(c: str) -> str:
    x, lo, hi, n = f"coalesce(s.{c}, 0)", f"b.{c}_min", f"b.{c}_max", f"b.{c}_count"
    return f"CASE WHEN {n} < 2 THEN greatest(0, least(1, {x})) WHEN {hi} = {lo} THEN CASE WHEN {x} >= {hi} THEN 1 ELSE 0 END ELSE greatest(0, least(1, ({x} - {lo}) / ({hi} - {lo}))) END"


def bounds(names) -> str:
    return ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, count({c}) AS {c}_count" for c in names)


def fused(weights: dict[str, float]) -> str:
    total = " + ".join(f"{w}::DOUBLE * ({norm(c)})" for c, w in weights.items())
    parts = ", ".join(f"round({norm(c)}, 6) AS {c}_norm" for c in weights)
    return f"{ALL}, b AS (SELECT profile_id, {bounds(weights)} FROM scores GROUP BY profile_id), fused AS (SELECT s.profile_id, s.item_id, s.seq, round({total}, 6) AS final_score, {parts} FROM scores s JOIN b USING (profile_id))"
