import numpy as np
import pytest

from sievepath.llm import vectors

SHAPE = "item_id string, seq bigint, v array<float>, doc bigint, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, v, 1, "clash") for i, s, v in rows], SHAPE)


def test_pairs_recall_and_cosines(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 64))
    near = base[:60] + 0.18 * rng.standard_normal((60, 64))
    x = np.concatenate([base, near, base[:5] * 3])
    df = frame(spark, [(f"{i:04}", i, [float(a) for a in v]) for i, v in enumerate(x)])
    got = {(int(r[0]), int(r[1])): r[2] for r in vectors.similar_pairs(spark, vectors.fit_rows(df, "v", 64), 0.92).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.92}
    assert set(got) <= want and len(got) >= 0.95 * len(want)
    assert all(abs(got[p] - s[p]) < 1e-5 for p in got)


@pytest.mark.parametrize("length", [64, 128])
def test_recall_at_the_floor(spark, length):
    rng = np.random.default_rng(length)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, y = unit(rng.standard_normal((600, length))), rng.standard_normal((600, length))
    y = unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    both = np.concatenate([x, 0.9202 * x + np.sqrt(1 - 0.9202**2) * y])
    df = frame(spark, [(f"{i:04}", i, [float(a) for a in v]) for i, v in enumerate(both)])
    got = {(int(r[0]), int(r[1])) for r in vectors.similar_pairs(spark, vectors.fit_rows(df, "v", length), 0.92).collect()}
    assert len(got & {(i, i + 600) for i in range(600)}) >= 0.9 * 600


def test_unusable_vectors_and_empty_tables(spark):
    v = [1.0] + [0.0] * 3
    rows = [("a", 1, v), ("b", 2, [2.0, 0.0, 0.0, 0.0]), ("a", 3, [0.0, 1.0, 0.0, 0.0]), ("c", 4, None), ("d", 5, []), ("e", 6, [0.0] * 4), ("f", 7, [float("nan")] * 4), ("g", 8, [float("inf"), 0.0, 0.0, 0.0]), ("h", 9, [1.0, None, 0.0, 0.0]), (None, 10, v), ("i", 11, [1.0] * 5)]
    got = vectors.similar_pairs(spark, vectors.fit_rows(frame(spark, rows), "v", 4), 0.92).collect()
    assert [tuple(r) for r in got] == [("a", "b", 1.0)]
    assert vectors.similar_pairs(spark, vectors.fit_rows(frame(spark, []), "v", 4), 0.92).count() == 0
    none = vectors.usable(frame(spark, []), "v", 4)
    assert vectors.nearest(spark, none, none).count() == 0


def test_mutual_top(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("a", "c", 0.98), ("b", "c", 0.97), ("c", "d", 0.96)], "item_id_a string, item_id_b string, cosine double")
    assert {tuple(r) for r in vectors.mutual(pairs, 1).collect()} == {("a", "b")}


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    df = frame(spark, [(f"{i:04}", i, [float(a) for a in v]) for i, v in enumerate(x)])
    every = vectors.usable(df, "v", 64)
    got = {}
    for r in vectors.nearest(spark, every, every.where("seq % 20 = 0"), block_bytes=1 << 14).collect():
        got.setdefault(r.item_id, []).append((r.place, r.neighbour_id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    hits = [len({n for _, n in got[f"{i:04}"]} & {f"{j:04}" for j in np.argsort(-s[i])[:10]}) for i in range(0, 2000, 20)]
    assert len(got) == 100 and all(len(v) == 10 for v in got.values()) and np.mean(hits) >= 9
