import numpy as np

from sievepath.llm import capping


def brute(rows, limit):
    by = {}
    for row, batch, who, score in rows:
        key = (who or "").strip().lower()
        if key:
            by.setdefault(key, []).append((-(max(score or 0, 0)), row))
    return {r for v in by.values() for _, r in sorted(v)[limit:]}


SHAPE = "row_id bigint, batch_no int, author struct<id:string>, votes bigint, who string, fate string"


def run(spark, rows, limit):
    df = spark.createDataFrame([(r, b, (w,), s, "clash", "clash") for r, b, w, s in rows], SHAPE)
    kept, log = capping.cap_contributors(spark, capping.contributions(df, "row_id", "batch_no", "author.id", "votes"), limit)
    return {r.row_id for r in kept.collect()}, {r.row_id for r in log.collect()}


def test_hot_contributor_ties_and_dirt(spark):
    rng = np.random.default_rng(2)
    names = ["hot"] * 6 + [" HOT　", "b", "B ", None, "", "  "]
    rows = [(i, int(rng.integers(0, 5)), names[int(rng.integers(0, len(names)))], [None, -1, 0, 1, 2, 3][int(rng.integers(0, 6))]) for i in range(400)]
    kept, log = run(spark, rows, 7)
    assert log == brute(rows, 7) and not kept & log
    assert len(kept) == 14


def test_empty_and_null_batch(spark):
    assert run(spark, [], 3) == (set(), set())
    kept, log = run(spark, [(1, None, "a", 5), (2, 0, "a", 6)], 1)
    assert (kept, log) == ({2}, {1})
