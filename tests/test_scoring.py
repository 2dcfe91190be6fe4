import numpy as np
import pytest
from pyspark.sql import functions as F

from sievepath.operators import recommend, scoring


def fused(spark, rows, weights):
    df = spark.createDataFrame(rows, "profile_id bigint, item_id string, seq bigint, i2i double, tag double, popularity double")
    return scoring.ranked(scoring.fused(df, weights), 10)


def test_worked_example(spark):
    rows = [(1, "001", 1, 0.8, 0.7, 0.9), (1, "002", 2, 0.6, 0.9, 0.5), (1, "003", 3, 0.9, 0.4, 0.8)]
    out = fused(spark, rows, {"i2i": 0.5, "tag": 0.3, "popularity": 0.2}).orderBy("rank").collect()
    assert [(r.item_id, r.final_score) for r in out] == [("001", 0.713333), ("003", 0.65), ("002", 0.3)]


def test_missing_component_is_a_raw_zero(spark):
    rows = [(1, "a", 1, 1.0, None, 5.0), (1, "b", 2, 2.0, None, None), (1, "c", 3, 3.0, None, 9.0)]
    out = {r.item_id: r for r in fused(spark, rows, {"popularity": 1.0, "tag": 1.0}).collect()}
    assert (out["a"].popularity_norm, out["b"].popularity_norm, out["c"].popularity_norm) == (0.0, 0.0, 1.0)
    assert out["a"].tag_norm == 0.0  # fewer than two scores: clipped


def test_constant_component_and_ties(spark):
    rows = [(1, "b", 1, 0.5, 0.5, 1.0), (1, "a", 2, 0.5, 0.5, 1.0)]
    out = fused(spark, rows, {"i2i": 1.0}).orderBy("rank").collect()
    assert [(r.item_id, r.i2i_norm) for r in out] == [("b", 1.0), ("a", 1.0)]


def test_veto_stretches_the_range(spark):
    df = spark.createDataFrame([(0.7, 0.9, 0.99), (0.7, 0.9, 0.5), (0.7, 0.8, 0.5)], "p double, n double, d double")
    got = [r[0] for r in df.select(scoring.penalised(F.col("p"), F.col("n"), F.col("d"))).collect()]
    assert got == pytest.approx([-999.0, 0.2, 0.7])


def test_weights_are_checked():
    with pytest.raises(ValueError):
        scoring.weights_of("none")
    with pytest.raises(ValueError):
        scoring.weights_of("balanced", {"colour": 1.0})
    merged = scoring.merge_rerank(scoring.PRESETS["balanced"])
    assert merged["rerank"] == 0.5 and sum(merged.values()) == pytest.approx(1.0)
    for preset in scoring.PRESETS.values():
        assert sum(preset.values()) == pytest.approx(1.0)


def test_tags(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "c"], []), (["a", "x"], ["a"], ["x"]), (["a"], ["a", "a"], [])], "t array<string>, p array<string>, n array<string>")
    assert [r[0] for r in df.select(scoring.tag_score(F.col("t"), F.col("p"), F.col("n"))).collect()] == [2.0, 0.0, 2.0]


def test_quality(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,)], "q string")
    assert [r[0] for r in df.select(scoring.quality_of(F.col("q"))).collect()] == pytest.approx([1.0, 0.6, 0.6])


def test_top_must_be_positive(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.5)], "profile_id bigint, item_id string, seq bigint, final_score double")
    with pytest.raises(ValueError):
        scoring.ranked(df, 0)


@pytest.mark.parametrize("window", [4, 4096])
def test_diversity_equals_the_greedy_loop(spark, window):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for p in (1, 2):
        vecs = [None if i % 9 == 0 else rng.standard_normal(6) for i in range(60)]
        score = np.round(rng.random(60), 3)
        rows += [(p, f"{p}-{i:02}", i, float(score[i]), None if v is None else v.tolist()) for i, v in enumerate(vecs)]
        unit = [None if v is None else v / (np.linalg.norm(v) + 1e-8) for v in vecs]
        order = sorted(range(60), key=lambda i: (-score[i], i))
        picked = [order[0]]
        while len(picked) < 8:
            def value(i):
                sims = [unit[i] @ unit[j] for j in picked if unit[i] is not None and unit[j] is not None]
                return 0.85 * score[i] - 0.15 * (max(sims) if sims else 0.0)
            best = None
            for i in order:
                if i not in picked and (best is None or value(i) > value(best) + 1e-12):
                    best = i
            picked.append(best)
        want += [(p, n + 1, f"{p}-{i:02}") for n, i in enumerate(picked)]
    df = spark.createDataFrame(rows, "profile_id bigint, item_id string, seq bigint, final_score double, embedding array<double>")
    got = recommend.diversified(df, top=8, window=window).orderBy("profile_id", "rank").collect()
    assert [(r.profile_id, r["rank"], r.item_id) for r in got] == want
