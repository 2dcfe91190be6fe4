import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievepath.functions import text
from sievepath.operators import evaluation, records
from sievepath.sources import files, sinks
from sievepath.streaming import feedback


def write(path, data):
    path.write_text(json.dumps(data) if not isinstance(data, str) else data, encoding="utf-8")
    return str(path)


def test_generic_items(spark, tmp_path):
    good = [{"id": " a ", "title": "t", "content": "c", "tags": ["x", " "], "metadata": {}}]
    row = files.items(spark, write(tmp_path / "a.json", good), "generic").first()
    assert (row.id, row.tags, row.metadata) == ("a", ["x"], {"source": "generic"})
    bad = [{"id": "a", "title": "t", "content": "c", "metadata": {}}]
    with pytest.raises(ValueError, match="missing required fields"):
        files.items(spark, write(tmp_path / "b.json", bad), "generic")
    with pytest.raises(ValueError):
        files.items(spark, write(tmp_path / "c.json", "{broken"), "generic")
    with pytest.raises(ValueError):
        files.items(spark, "x", "odd")


def test_platform_items(spark, tmp_path):
    rows = [{"id": "1", "content": "", "excerpt": "short", "author": {"name": "n"}, "voteup_count": 3}, {"title": "only"}]
    got = files.items(spark, write(tmp_path / "a.json", rows), "platform").orderBy("id").collect()
    assert got[1].content == "short" and got[1].metadata["author"] == "n" and got[1].metadata["voteup_count"] == "3"
    assert (got[0].title, got[0].content, got[0].tags) == ("only", "", [])


def test_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "one.md", "---\ntitle: 'First'\ntags: [a, b]\n---\nBody here\n")
    write(tmp_path / "sub" / "two.md", "no front matter")
    got = {r.title: r for r in files.notes(spark, str(tmp_path)).collect()}
    assert got["First"].content == "Body here" and got["First"].tags == ["a", "b"]
    assert got["two"].content == "no front matter" and got["two"].tags == []


def test_feed(spark, tmp_path):
    entries = "".join(f"<item><title>t{i}</title><link>https://x.example/{i}</link><description>&lt;p&gt;d{i}&lt;/p&gt;</description></item>" for i in range(5))
    write(tmp_path / "f.xml", f"<rss><channel>{entries}</channel></rss>")
    got = files.feed(spark, str(tmp_path / "f.xml")).orderBy("link").collect()
    assert [r.title for r in got] == ["t0", "t1", "t2"] and got[0].content == "d0" and got[0].id.startswith("rss_")


def test_impressions_and_latest(spark, tmp_path):
    write(tmp_path / "i.csv", "1,2,100,0\n1,3,100,160\n")
    assert files.impressions(spark, str(tmp_path / "i.csv")).where("click_ts > 0").count() == 1
    write(tmp_path / "a_checkpoint.json", "[]")
    write(tmp_path / "b.json", "[]")
    assert files.latest_file(spark, str(tmp_path)).endswith("b.json")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ("x", 2), [1])], "id bigint, a struct<b:string,c:int>, l array<int>")
    assert records.flat(df).columns == ["id", "a_b", "a_c", "l"]
    clash = spark.createDataFrame([("y", ("x",))], "a_b string, a struct<b:string>")
    assert records.flat(clash).columns == ["a_b", "a_b_2"]
    sinks.export(df, str(tmp_path), "out")
    assert spark.read.csv(f"{tmp_path}/out.csv", header=True).columns == ["id", "a_b", "a_c", "l"]
    path = f"{tmp_path}/t"
    assert sinks.keep_richer(spark, spark.range(5), path) and not sinks.keep_richer(spark, spark.range(3), path)
    assert spark.read.parquet(path).count() == 5


def test_briefing_round_trip(spark):
    ranked = spark.createDataFrame([(1, 1, "a", "A"), (1, 2, "b", None)], "profile_id bigint, rank bigint, item_id string, title string")
    md = sinks.briefing(ranked)
    ticked = md.withColumn("markdown", F.regexp_replace("markdown", r"(?s)(item_id: b.*?)\[ \] like", "$1[x] like"))
    assert [r.item_id for r in sinks.briefing_feedback(ticked).collect()] == ["b"]


def test_reply_json(spark):
    cases = ["```json\n{\"a\": 1}\n```", "hm <think>{\"a\": 9}</think> {\"a\": 2}", "thought</think>{\"a\": 3}", "nothing"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(F.get_json_object(text.reply_json(F.col("t")), "$.a")).collect()] == ["1", "2", "3", None]


def test_tree_orphans_become_roots(spark):
    nodes = spark.createDataFrame([("a", None, 1.0, 1), ("b", "a", 5.0, 1), ("c", "a", 9.0, 1), ("d", "gone", 7.0, 1)], "id string, parent string, score double, posted bigint")
    assert [r.id for r in records.tree(nodes).orderBy("path").collect()] == ["d", "a", "c", "b"]


def test_tree_of_any_depth_and_cycles(spark):
    shape = "id string, parent string, score double, posted bigint"
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None, 0.0, 0) for i in range(70)], shape)
    assert records.tree(chain).agg(F.max("depth")).first()[0] == 69
    with pytest.raises(ValueError):
        records.tree(spark.createDataFrame([("a", "b", 0.0, 0), ("b", "a", 0.0, 0), ("c", None, 0.0, 0)], shape))


def test_note_ids_follow_the_inner_path(spark, tmp_path):
    for top in ("x", "y"):
        (tmp_path / top / "vault" / "sub").mkdir(parents=True)
        (tmp_path / top / "vault" / "sub" / "n.md").write_text("hello")
    one, two = (files.notes(spark, str(tmp_path / top / "vault")).first().id for top in ("x", "y"))
    assert one == two == hashlib.md5(b"sub/n.md").hexdigest()


def test_chunks(spark):
    df = spark.createDataFrame([(1, "A" * 1600 + "B" * 1600), (2, ""), (3, None), (4, "x")], "id bigint, body string")
    got = records.chunks(df, "id", "body").collect()
    mine = sorted((r.chunk_no, r.chunk) for r in got if r.id == 1)
    text_ = mine[0][1] + "".join(c[150:] for _, c in mine[1:])
    assert text_ == "A" * 1600 + "B" * 1600 and len(mine) >= 2 and {r.id for r in got} == {1, 4}


def test_metrics(spark):
    df = spark.createDataFrame([(2, [2, 1, 0]), (3, [1, 0, 3])], "target int, ranked array<int>")
    assert evaluation.list_metrics(df, 2).first().recall == 0.5


def test_ratings_are_bounded_and_repeatable(spark):
    games = [("x", i, "A", "B", 1.0) for i in range(10)] + [("x", 20 + i, "C", "D", 0.5) for i in range(5)]
    df = spark.createDataFrame(games, "arena string, at bigint, a string, b string, score double")
    one, two = ({r.player: r.rating for r in evaluation.glicko(df).collect()} for _ in range(2))
    assert one == two and one["A"] > 1500 > one["B"] and abs(one["C"] - 1500) < 1 and all(0 < v < 3000 for v in one.values())


def test_rating_step_of_the_published_example_and_of_certain_games():
    player = lambda rating, deviation: ((rating - 1500) / evaluation.SCALE, deviation / evaluation.SCALE)
    mu, phi, sigma = evaluation._glicko_step(*player(1500, 200), 0.06, [(*player(1400, 30), 1), (*player(1550, 100), 0), (*player(1700, 300), 0)])
    assert (round(1500 + evaluation.SCALE * mu, 1), round(evaluation.SCALE * phi, 1), round(sigma, 5)) == (1464.1, 151.5, 0.06)
    for far in (40.0, 900.0, -900.0):  # both sides of what floating point tells from 0 and 1, and an upset
        for score in (0, 1):
            mu, phi, sigma = evaluation._glicko_step(far, 0.5, 0.06, [(0.0, 0.3, score)])
            assert abs(mu - far) < 1 and phi < 1 and 0.05 < sigma < 0.07
    for k in range(3000):  # erratic players stay no less certain than new ones
        mu, phi, sigma = evaluation._glicko_step(mu, phi, sigma if k else 1.5, [(0.0, 0.3, k // 20 % 2)])
        assert phi <= evaluation.SPREAD / evaluation.SCALE and sigma < 100 and abs(mu) < 1000


def test_ratings_do_not_follow_the_order_of_rows(spark):
    games = [(f"x{i % 3}", "2020", i, "A", "B" if i % 2 else "C", i * 7 % 3 / 2) for i in range(300)]
    read = lambda rows: sorted(map(tuple, evaluation.glicko(spark.createDataFrame(rows, "arena string, at string, game bigint, a string, b string, score double")).collect()))
    got = read(games)
    assert got == read(games[::-1]) and [r[0:2] for r in got] == [(f"x{i}", p) for i in range(3) for p in "ABC"] and sum(r[4] for r in got) == 600


def test_winner_rule(spark):
    runs = spark.createDataFrame([("w3", 10, 10, 0.02, 0.2, 1000.0), ("w6", 10, 10, 0.025, 0.1, 900.0), ("w9", 9, 10, 0.0, 0.0, 800.0)], "run string, pairs_done int, pairs_total int, error_rate double, flip_rate double, seconds double")
    assert evaluation.chosen_winner(runs).first().run == "w6"


def test_stream_dedupe(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, s bigint").select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    q = feedback.distinct_stream(stream, "k", "ts", "1 hour").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
