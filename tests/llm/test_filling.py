import numpy as np
import pytest
from pyspark.sql import functions as F

from sievepath.llm import _tokens, mixing, packing

DOCS = "doc_id bigint, text string, source string, n_tokens bigint, block int, uses int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1, 1) for i, t, s in rows], DOCS)


def kinds(spark, rows):
    return spark.createDataFrame(rows, "container_kind string, capacity_tokens int")


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted((s for s in sizes if s), reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_place_never_overfills():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 101, 3000)
    where, gaps = packing.place(sizes, 100)
    used = np.bincount(where, sizes, minlength=len(gaps))
    assert (used <= 100).all() and (100 - used == gaps).all()
    assert len(gaps) <= 1.03 * best_fit_decreasing(sizes.tolist(), 100)


def test_pack_keeps_every_token_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "word " * int(rng.integers(0, 300)), "a") for i in range(120)] + [(7, "word again", "a"), (200, None, None), (201, "", "a"), (None, "word", "a"), (202, "长文本" * 4000, "a")]
    df = docs(spark, rows)
    out = packing.pack(spark, df, kinds(spark, [("s", 64), ("l", 500), ("bad", 0), ("worse", None)]), shard=40)
    sizes = [c for c in _tokens.counts([t for _, t, _ in rows])]
    got = out.toPandas()
    for kind, cap in (("s", 64), ("l", 500)):
        mine = got[got.container_kind == kind]
        assert mine.n_tokens.sum() == sum(sizes)
        assert mine.groupby("container_id").n_tokens.sum().max() <= cap
        pieces = mine.groupby("doc_id", dropna=False).agg(n=("piece_no", "count"), t=("n_tokens", "sum"))
        assert pieces.loc[202, "n"] == -(-sizes[-1] // cap) and pieces.loc[202, "t"] == sizes[-1]
        assert len(pieces) == len({i for i, _, _ in rows})
        small = [i for (i, _, _), n in zip(rows, sizes) if n <= cap and i not in (7, None)]
        assert (pieces.loc[small, "n"] == 1).all()
    assert set(got.container_kind) == {"s", "l"}


def test_pack_empty(spark):
    assert packing.pack(spark, docs(spark, []), kinds(spark, [("s", 64)])).count() == 0
    assert packing.pack(spark, docs(spark, [(1, "x", "a")]), kinds(spark, [])).count() == 0


def test_quotas_split_exactly():
    q = [1000, 0, 37, 5]
    parts = mixing.split_quotas(q, 16)
    assert parts.sum(axis=0).tolist() == q and np.ptp(parts.sum(axis=1)) <= 1 and (parts >= 0).all()
    assert (mixing.split_quotas(q, 16) == parts).all()


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix_shares_caps_and_order(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(rng.integers(5, 40)), ["A ", "a", " b", "c", None, "z"][i % 6]) for i in range(900)]
    m = mixing.Mix(spark, docs(spark, rows), targets(spark, [("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2), ("c", 0.0, 2)]), shards=8)
    uses = m.uses().toPandas()
    assert len(uses) == 900 and uses[uses.source == "b"].uses.max() <= 3 and uses[uses.source == "a"].uses.max() <= 1
    assert uses[~uses.source.isin(["a", "b"])].uses.sum() == 0
    share = {r.source: r.actual_share for r in m.shares().collect()}
    assert share["none"] == 0 and share["a"] == pytest.approx(5 / 9, abs=0.01) and share["b"] == pytest.approx(4 / 9, abs=0.01)
    order = m.order().toPandas()
    assert len(order) == uses.uses.sum() and not order.duplicated(["doc_id", "use_no"]).any() and set(order.shard) == set(range(8))


def test_mix_edge_cases(spark):
    t = targets(spark, [("a", 0.5, 2), (None, 0.5, 2), ("b", None, None)])
    m = mixing.Mix(spark, docs(spark, []), t, shards=4)
    assert m.uses().count() == 0 and m.order().count() == 0 and {r.actual_share for r in m.shares().collect()} == {0.0}
    m = mixing.Mix(spark, docs(spark, [(1, None, "a"), (2, "", "a"), (2, "x y", "a"), (3, "x", None)]), t, shards=4)
    assert m.uses().where(F.col("source") == "a").agg(F.max("uses")).first()[0] == 2
