"""Operators that no SQL query covers, against hand-made cases."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sievepath.operators import arena, extension, jobs, rerank, state
from sievepath.sources import lenient


def test_payloads_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "n": "7"}, 5, {"url": "u", "n": "x", "more": {}}]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"id": "1", "n": 8}, {"id": None, "url": "", "n": 1}]}))
    (tmp_path / "c.json").write_text("not json")
    rows = {r.key: r.n for r in lenient.payload_records(spark, str(tmp_path), {"id": "string", "url": "string", "n": "int"}).collect()}
    assert rows["1"] == 8 and rows["u"] is None and len(rows) == 3


def test_gzip_head_keeps_order(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("\n".join(str(i) for i in range(1000)))
    head = lenient.head_csv(spark, str(tmp_path / "x.csv.gz"), 10)
    assert [r.value for r in head.collect()] == [str(i) for i in range(10)]
    assert [tuple(r) for r in lenient.manifest({"x": head}).collect()] == [("x", 10, 10)]


def test_anchor_file_and_markers(spark, tmp_path):
    (tmp_path / "n.md").write_text("  \n # 笔记 \n")
    assert lenient.anchor_file(spark, str(tmp_path / "n.md")) == "# 笔记" and lenient.anchor_file(spark, str(tmp_path / "none.md")) == ""
    df = spark.createDataFrame([("成功爬取 0 条内容",), ("ok a.json b/c.json a.json",), (None,)], "log string")
    got = df.select(lenient.looks_empty(F.col("log")).alias("e"), lenient.output_paths(F.col("log")).alias("p")).collect()
    assert [(r.e, r.p) for r in got] == [(True, []), (False, ["a.json", "b/c.json"]), (False, [])]


@pytest.mark.parametrize(
    "reply, score, sure, topics, concerns",
    [
        ('{"relevance_score": 8, "confidence": 0.9, "matched_topics": ["a", "b"], "concerns": "x"}', 8.0, 0.9, ["a", "b"], ["x"]),
        ('<think>{"relevance_score": 1}</think>```json\n{"relevance_score": "7.5", "confidence": "high"}\n```', 7.5, 0.5, [], []),
        ('{"relevance_score": null}', 5.0, 0.5, [], []),
        ("no object", 5.0, 0.1, [], ["parse_error"]),
        ('{"broken": ', 5.0, 0.1, [], ["parse_error"]),
        (None, 5.0, 0.1, [], ["parse_error"]),
    ],
)
def test_reply_fields(spark, reply, score, sure, topics, concerns):
    f = rerank.reply_fields(F.col("reply"))
    r = spark.createDataFrame([(reply,)], "reply string").select(*[c.alias(n) for n, c in f.items()]).first()
    assert (r.relevance_score, r.confidence, r.matched_topics, r.concerns) == (score, sure, topics, concerns)
    assert r.reasoning.startswith("parse_failed") == (sure == 0.1)


class Judge:
    """Fails on batches that hold a bad prompt."""

    def complete(self, prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("down")
        return ['{"relevance_score": %d}' % len(p) for p in prompts]


def test_rerank_with_a_model(spark):
    top = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "xxxx"), (1, "c", 3, "xxxxxx")], "profile_id bigint, item_id string, rank int, prompt string")
    out = rerank.rerank(top, lambda p: extension.ask(p, Judge(), ["profile_id", "item_id"], "prompt"))
    assert [(r.item_id, r.new_rank) for r in out.orderBy("new_rank").collect()] == [("c", 1), ("b", 2), ("a", 3)]
    assert [r.new_rank for r in rerank.rerank(top, None).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.new_rank for r in rerank.rerank(top, lambda p: p, explicit=False).orderBy("rank").collect()] == [1, 2, 3]
    failed = extension.ask(top.withColumn("prompt", F.lit("bad")), Judge(), ["item_id"], "prompt", default="none")
    assert {r.reply for r in failed.collect()} == {"none"}
    assert {r.relevance_score for r in rerank.cross_encoded(top, F.when(F.col("item_id") == "a", 0.7)).collect()} == {7.0, 5.0}


def test_feedback_bounds(spark):
    df = spark.createDataFrame([(0.9, 0.1, 0.96), (0.9, 0.85, 0.1), (0.9, 0.8, 0.95)], "s double, d double, u double")
    assert [round(r[0], 6) for r in df.select(rerank.with_feedback(F.col("s"), F.col("d"), F.col("u"))).collect()] == [-999.0, 0.4, 0.9]


def test_choices_decisions_and_attribution(spark):
    df = spark.createDataFrame([("A ",), ("b",), ("X1",), ("y2",), ("平局",), ("?",), (None,)], "raw string")
    assert [r[0] for r in df.select(arena.choice(F.col("raw"), F.lit("x1"), F.lit("y2"))).collect()] == ["A", "B", "A", "B", "tie", None, None]
    d = spark.createDataFrame([("a", "b", "A", 1), ("a", "b", "B", 2), ("a", "c", "A", 1)], "a string, b string, winner string, at int")
    once = arena.decisions(d, ["a", "b"], "at")
    assert {(r.b, r.winner) for r in once.collect()} == {("b", "B"), ("c", "A")}
    assert arena.pending(d.select("a", "b").distinct(), once.where("b = 'b'"), ["a", "b"]).collect()[0].b == "c"
    w = spark.createDataFrame([(0.9, 0.1), (0.1, 0.9), (0.9, 0.9), (0.0, 0.0)], "f double, v double")
    assert [r[0] for r in w.select(arena.instability(F.col("f"), F.col("v"))).collect()] == ["judge_order_bias", "reranker_variance", "balanced_or_low_signal", "balanced_or_low_signal"]


def test_swiss_round(spark):
    r = spark.createDataFrame([("x", p, 1500.0 + i, 350.0 - i) for i, p in enumerate("abcd")], "arena string, player string, rating double, rd double")
    none = spark.createDataFrame([], "arena string, a string, b string")
    assert {(x.a, x.b) for x in arena.swiss_pairs(r, none).collect()} == {("a", "b"), ("c", "d")}
    assert {(x.a, x.b) for x in arena.swiss_pairs(r, spark.createDataFrame([("x", "b", "a")], none.schema)).collect()} == {("c", "d")}


def test_guards_and_known_fields(spark):
    some, empty = spark.range(1), spark.range(0)
    state.require_inputs(some, some)
    with pytest.raises(ValueError, match="candidates"):
        state.require_inputs(some, empty)
    row = state.known_fields(spark.createDataFrame([("7", "x")], "n string, extra string"), {"n": "int", "t": "string"}).first()
    assert row.n == 7 and row.t is None and len(row) == 2
    parts = spark.createDataFrame([("a", True, 5), ("b", True, 5)], "part string, present boolean, total int")
    assert state.resumability(parts).first().asDict() == {"files_exist": True, "totals_aligned": True}


def test_embedder_shapes_and_cache(spark):
    items = spark.createDataFrame([("a", "t", "x"), ("b", "t", "y"), ("c", None, None)], "item_id string, title string, content string")
    cache = items.where("item_id = 'a'").select("item_id", state.text_key(F.col("title"), F.col("content")).alias("text_hash"), F.array(F.lit(1.0)).cast("array<float>").alias("vec"))
    cache = cache.unionByName(spark.createDataFrame([("b", "old", [1.0]), ("gone", "z", [1.0])], cache.schema))
    hits, misses = state.probe(items, cache)
    assert [r.item_id for r in hits.collect()] == ["a"] and sorted(r.item_id for r in misses.collect()) == ["b", "c"]
    vec = extension.embed(items, extension.HashingEmbedder(8), "item_id", F.col("content")).collect()
    assert {len(r.vec) for r in vec} == {8} and extension.fitted(extension.HashingEmbedder(8).embed_batch(["x"]), 10).shape == (1, 10)


def test_run_artifacts_and_log(spark, tmp_path):
    ranked = spark.createDataFrame([("a", 0.12345678)], "item_id string, final_score double")
    state.save_run(ranked, {"top_k": 20}, spark.range(1), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/recommendations")).first().final_score == 0.123457
    for _ in range(2):
        state.append_log(ranked, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        extension.Registry().scores(ranked, ranked)


def test_fetching_and_enriching(spark):
    items = spark.createDataFrame([("a", "ok", "old"), ("b", "bad", "old"), ("c", None, "old")], "id string, url string, content string")

    def fetch(url):
        if url == "bad":
            raise OSError("down")
        return "new"

    got = jobs.fetched(items, fetch, "id", "url")
    assert {(r.id, r.body) for r in got.collect()} == {("a", "new"), ("b", ""), ("c", "")}
    assert {(r.id, r.content) for r in jobs.enriched(items, got, "id", "content").collect()} == {("a", "new"), ("b", "old"), ("c", "old")}


def test_compiling_skips_what_is_done(spark):
    files = spark.createDataFrame([("x", "---\ntitle: T\nsource: s\n---\nbody"), ("y", "plain"), ("z", "done")], "name string, value string")
    replies = spark.createDataFrame([("x", '```json\n{"title": "M", "topic": "q"}\n```'), ("y", "nothing")], "name string, reply string")
    got = {r.name: (r.metadata, r.from_model) for r in jobs.compiled(files, files.where("name = 'z'"), lambda _: replies).collect()}
    assert got == {"x": ({"source": "s", "title": "M", "topic": "q"}, True), "y": ({}, False)}


def test_daily_steps_and_timing(spark):
    stages = jobs.Stages()
    assert stages.run("one", lambda: 7) == 7 and "one" in stages.seconds
    ran = []
    steps = {"a": lambda: ran.append("a"), "b": lambda: 1 / 0, "c": lambda: ran.append("c")}
    assert jobs.daily(spark, steps) == {"a": "ok", "b": "failed: ZeroDivisionError", "c": "ok"} and ran == ["a", "c"]
    assert list(jobs.daily(spark, steps, stop_on=("b",))) == ["a", "b"]


def test_delivery_by_micro_batch(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    jobs.deliver(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    assert sum(seen) == 3
