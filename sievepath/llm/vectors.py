"""Most similar vectors by multi-probe p-stable hashing.

Each table cuts unit vectors with HASHES random projections into cells of WIDTH. A vector
looks into its own cell and, in the order of estimated success (least squared distance to
the walls that a perturbation crosses), into PROBES perturbed ones. Candidates of all tables
are merged and ranked by the exact cosine.

``similar_pairs`` joins all vectors with all: keys and probes meet by key in packed arrays, so
no vector is moved per probe; exact copies are one class; cells of any size are expanded in
blocks. Wide cells meet many vectors below the floor, so every entry carries 64 signs of random
projections, and pairs whose signs differ by more than three sigma above what the floor lets
expect are dropped before a vector is read for them. With the defaults, recall of pairs planted
at a cosine of 0.92 itself is over 0.9 (README has it by band). ``nearest`` serves a stated query set with coarse cells
for neighbours at any distance; queries are sent in blocks of a checked size.

Usable vectors have the stated length, finite numbers only and a length over zero; all others
take part in nothing. An item delivered again counts once, with its first usable vector. Equal
cosines are ranked by item id.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch

TABLES, HASHES, WIDTH, PROBES = 14, 20, 2.1, 5
ENTRY = np.dtype([("key", "<u4"), ("doc", "<i8"), ("signs", "<u8")])
NEAREST_WALLS = 6
ROWS = 25_000  # items whose keys and probes one task meets, about 42 MB


def fit_rows(df: DataFrame, field: str, length: int, item: str = "item_id", seq: str = "seq") -> DataFrame:
    """(item_id, seq, vec) of every row with a usable vector."""
    v = F.col(field)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(item).isNotNull() & F.col(seq).isNotNull() & (F.size(v) == length) & fine).select(F.col(item).alias("item_id"), F.col(seq).cast("bigint").alias("seq"), v.cast("array<float>").alias("vec"))


def usable(df: DataFrame, field: str, length: int, item: str = "item_id", seq: str = "seq") -> DataFrame:
    """As fit_rows, one an item."""
    rows = fit_rows(df, field, length, item, seq)
    first = rows.groupBy("item_id").agg(F.min("seq").alias("seq"))
    return rows.join(first, ["item_id", "seq"]).dropDuplicates(["item_id"])


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _table(length: int, t: int, hashes: int, width: float):
    rng = np.random.default_rng([length, t])
    return rng.standard_normal((length, hashes)), rng.random(hashes) * width, rng.integers(1, 1 << 62, size=hashes, dtype=np.int64) | 1


def _perturbations() -> list[tuple[int, ...]]:
    return [c for r in (1, 2, 3) for c in itertools.combinations(range(NEAREST_WALLS), r)]


def _keys(x: np.ndarray, t: int, hashes: int, width: float, probes: int) -> np.ndarray:
    """Own key first, then the keys of the perturbed cells in order of estimated success."""
    a, b, mul = _table(x.shape[1], t, hashes, width)
    y = (x @ a + b) / width
    cell = np.floor(y)
    part = y - cell
    own = (cell.astype(np.int64) * mul).sum(axis=1)
    walls = np.concatenate([part**2, (1 - part) ** 2], axis=1)
    steps = np.concatenate([-mul, mul])
    near = np.argsort(walls, axis=1)[:, :NEAREST_WALLS]
    cost = np.take_along_axis(walls, near, axis=1)
    sets = _perturbations()
    total = np.stack([cost[:, list(c)].sum(axis=1) for c in sets], axis=1)
    delta = np.stack([steps[near[:, list(c)]].sum(axis=1) for c in sets], axis=1)
    for k, c in enumerate(sets):
        for u, v in itertools.combinations(c, 2):  # both walls of one hash
            total[near[:, u] % hashes == near[:, v] % hashes, k] = np.inf
    best = np.argsort(total, axis=1)[:, :probes]
    keys = np.concatenate([own[:, None], own[:, None] + np.take_along_axis(delta, best, axis=1)], axis=1).view(np.uint64)
    return (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)


def _signs(x: np.ndarray) -> np.ndarray:
    """On which side of 64 random planes each vector lies, as the bits of one word."""
    planes = np.random.default_rng([x.shape[1], 1 << 20]).standard_normal((x.shape[1], 64))
    return np.packbits(x @ planes > 0, axis=1).view(np.uint64).ravel()


def _unlike(floor: float) -> float:
    """The most signs in which a pair of at least ``floor`` differs, three sigma above the expected."""
    p = np.arccos(np.clip(floor, -1, 1)) / np.pi
    return 64 * p + 3 * np.sqrt(64 * p * (1 - p))


def _docs(batch: pa.RecordBatch) -> np.ndarray:
    """A class for each vector: equal directions share it."""
    x = np.ascontiguousarray(_unit(batch.column("vec")).astype(np.float32).round(6) + 0.0)
    return np.array([xxhash.xxh3_64_intdigest(v.tobytes()) - (1 << 63) for v in x], dtype=np.int64)


def _classes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("seq"), pa.array(_docs(batch), pa.int64())], names=["item_id", "seq", "doc"])


def _emit(slices: int, tables: int, hashes: int, width: float, probes: int):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            docs, at = np.unique(_docs(batch), return_index=True)
            x = _unit(batch.column("vec"))[at]
            signs = _signs(x)
            homes, visits, hs, vs = [], [], [], []
            with np.errstate(over="ignore"):
                for t in range(tables):
                    keys = _keys(x, t, hashes, width, probes)
                    part, high = (keys % np.uint64(slices)).astype(np.int64), (keys >> np.uint64(32)).astype(np.uint32)
                    homes.append(np.rec.fromarrays([high[:, 0], docs, signs], dtype=ENTRY))
                    visits.append(np.rec.fromarrays([high[:, 1:].ravel(), np.repeat(docs, probes), np.repeat(signs, probes)], dtype=ENTRY))
                    hs.append(part[:, 0])
                    vs.append(part[:, 1:].ravel())
            homes, visits, hs, vs = (np.concatenate(z) for z in (homes, visits, hs, vs))
            ho, vo = np.argsort(hs, kind="stable"), np.argsort(vs, kind="stable")
            hc, vc = np.searchsorted(hs[ho], np.arange(slices + 1)), np.searchsorted(vs[vo], np.arange(slices + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slices), pa.int32()), pa.array([homes[ho[hc[i] : hc[i + 1]]].tobytes() for i in range(slices)], pa.binary()), pa.array([visits[vo[vc[i] : vc[i + 1]]].tobytes() for i in range(slices)], pa.binary())],
                names=["slice", "homes", "visits"],
            )

    return run


def _once(rows: np.ndarray) -> np.ndarray:
    """By key and doc, each once: copies come from several tasks."""
    rows = rows[np.lexsort((rows["doc"], rows["key"]))]
    same = (rows["key"][1:] == rows["key"][:-1]) & (rows["doc"][1:] == rows["doc"][:-1])
    return rows[np.concatenate([np.ones(min(len(rows), 1), dtype=bool), ~same])]


def _meet(floor: float, most: int = 2_000_000):
    unlike = _unlike(floor)

    def run(batches):
        held = defaultdict(lambda: ([], []))
        for batch in batches:
            for s, h, v in zip(*(batch.column(c).to_pylist() for c in ("slice", "homes", "visits"))):
                held[s][0].append(np.frombuffer(h, dtype=ENTRY))
                held[s][1].append(np.frombuffer(v, dtype=ENTRY))
        for s in list(held):
            h, v = (_once(np.concatenate(x)) for x in held.pop(s))
            seekers, home, doc, signs = np.concatenate([h, v]), h["key"].copy(), h["doc"].copy(), h["signs"].copy()
            lo, hi = np.searchsorted(home, seekers["key"], side="left"), np.searchsorted(home, seekers["key"], side="right")
            n = hi - lo
            total, start, found = np.cumsum(n), 0, []
            while start < len(n):
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
                c = n[start:stop]
                q = np.repeat(np.arange(start, stop), c)
                at = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[start:stop], c)
                near = np.bitwise_count(seekers["signs"][q] ^ signs[at]) <= unlike
                a, b = seekers["doc"][q[near]], doc[at[near]]
                m = a != b
                found.append(np.unique(np.stack([np.minimum(a, b)[m], np.maximum(a, b)[m]], axis=1), axis=0))
                start = stop
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["doc_a", "doc_b"])

    return run


def _score(floor: float):
    def run(batches):
        for batch in batches:
            cos = np.einsum("ij,ij->i", _unit(batch.column("vec_a")), _unit(batch.column("vec_b"))) if len(batch) else np.zeros(0)
            keep = cos >= floor - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[keep]) for c in ("doc_a", "doc_b")] + [pa.array(cos[keep])], names=["doc_a", "doc_b", "cosine"])

    return run


def similar_pairs(spark: SparkSession, vectors: DataFrame, floor: float, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """(item_id_a, item_id_b, cosine), a < b, of ``vectors`` (item_id, seq, vec) with a cosine of at least ``floor``."""
    store = Scratch(spark, "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = vectors.mapInArrow(_classes, "item_id string, seq bigint, doc bigint")
    members = store.write(every.groupBy("item_id").agg(F.min(F.struct("seq", "doc")).alias("x")).select("item_id", "x.seq", "x.doc"), "members")
    parts = max(parts, members.count() // ROWS)
    met = vectors.mapInArrow(_emit(parts * 2, tables, hashes, width, probes), "slice int, homes binary, visits binary").repartition(parts, "slice").mapInArrow(_meet(floor), "doc_a bigint, doc_b bigint")
    reps = members.groupBy("doc").agg(F.min("seq").alias("seq"))
    pairs = met.distinct().join(reps.select(F.col("doc").alias("doc_a"), F.col("seq").alias("seq_a")), "doc_a").join(reps.select(F.col("doc").alias("doc_b"), F.col("seq").alias("seq_b")), "doc_b")
    pairs = store.write(pairs, "pairs")
    known = vectors.select("seq", "vec")  # both joins use one exchange of it
    half = pairs.withColumnRenamed("seq_b", "seq").join(known, "seq").select("doc_a", "doc_b", F.col("seq_a").alias("seq"), F.col("vec").alias("vec_b"))
    both = half.join(known, "seq").select("doc_a", "doc_b", F.col("vec").alias("vec_a"), "vec_b")
    scored = store.write(both.mapInArrow(_score(floor), "doc_a bigint, doc_b bigint, cosine double").dropDuplicates(["doc_a", "doc_b"]), "scored")
    a, b = members.select(F.col("doc").alias("doc_a"), F.col("item_id").alias("x")), members.select(F.col("doc").alias("doc_b"), F.col("item_id").alias("y"))
    across = scored.join(a, "doc_a").join(b, "doc_b").select("x", "y", "cosine")
    shared = members.withColumn("n", F.count("*").over(Window.partitionBy("doc"))).where("n > 1")
    same = shared.select("doc", F.col("item_id").alias("x")).join(shared.select("doc", F.col("item_id").alias("y")), "doc").where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    return across.unionByName(same).select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b"), "cosine")


def mutual(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of which each is among the ``k`` most similar of the other. Complete if ``pairs`` holds all of
    a floor, as whatever ranks before such a pair is in it too."""
    ends = pairs.select(F.col("item_id_a").alias("x"), F.col("item_id_b").alias("y"), "cosine").unionByName(pairs.select(F.col("item_id_b").alias("x"), F.col("item_id_a").alias("y"), "cosine"))
    top = ends.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "y"))).where(F.col("place") <= k)
    return top.groupBy(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b")).agg(F.count("*").alias("n")).where("n = 2").drop("n")


def _search(queries, k: int, tables: int, hashes: int, width: float, probes: int, most: int = 4096):
    def local(x: np.ndarray, ids: np.ndarray, q: np.ndarray, names: np.ndarray):
        seen = np.zeros((len(q), len(x)), dtype=bool)
        for t in range(tables):
            a, b, _ = _table(x.shape[1], t, hashes, width)
            cells, at = np.unique(np.floor((x @ a + b) / width), axis=0, return_inverse=True)
            y = (q @ a + b) / width
            cost = np.zeros((len(q), len(cells)))
            for m in range(hashes):
                cost += np.maximum(np.maximum(cells[None, :, m] - y[:, None, m], y[:, None, m] - cells[None, :, m] - 1), 0) ** 2
            pick = np.zeros(cost.shape, dtype=bool)
            visits = max(1, int(np.ceil(probes * len(cells))))
            np.put_along_axis(pick, np.argpartition(cost, min(visits, len(cells)) - 1, axis=1)[:, :visits], True, axis=1)
            seen |= pick[:, at.ravel()]
        cos = np.where(seen & (names[:, None] != ids[None, :]), q @ x.T, -2.0)
        top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(cos, top, axis=1)
        row, col = np.nonzero(score > -2)
        return names[row], ids[top[row, col]], score[row, col]

    def run(batches):
        names, q = queries.value
        for batch in batches:
            x, ids = _unit(batch.column("vec")), np.array(batch.column("item_id").to_pylist(), dtype=object)
            for s in range(0, len(ids), most):
                for u in range(0, len(names), 512):
                    a, b, c = local(x[s : s + most], ids[s : s + most], q[u : u + 512], names[u : u + 512])
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c)], names=["item_id", "neighbour_id", "cosine"])

    return run


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 6, hashes: int = 8, width: float = 1.5, probes: float = 0.1, block_bytes: int = 16 << 20) -> DataFrame:
    """The ``k`` most similar vectors of each query: (item_id, neighbour_id, cosine, place). ``probes`` is the
    share of cells that a query visits in each table. Queries are broadcast in blocks of at most
    ``block_bytes``, each a pass over all vectors that moves no vector."""
    store = Scratch(spark, "nearest")
    vectors, queries = store.write(vectors, "vectors"), store.write(queries, "queries")
    n = queries.count()
    if not n:
        return spark.createDataFrame([], "item_id string, neighbour_id string, cosine double, place int")
    length = queries.select(F.size("vec")).first()[0]
    passes = -(-n * (8 * length + 64) // block_bytes)
    found = []
    for p in range(passes):
        mine = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).select("item_id", "vec").toArrow()
        sent = spark.sparkContext.broadcast((np.array(mine.column("item_id").to_pylist(), dtype=object), _unit(mine.column("vec"))))
        part = vectors.mapInArrow(_search(sent, k, tables, hashes, width, probes), "item_id string, neighbour_id string, cosine double")
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("cosine"), "neighbour_id"))
        found.append(store.write(part.withColumn("place", place).where(F.col("place") <= k), f"found{p}"))
        sent.unpersist()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
