"""Pairs and groups of near-identical texts in a pool too large for pairwise comparison.

Two texts match if their distinct five-character runs (see ``_text``) agree to at least
``threshold``. Candidates come from rare-first prefix filtering:

1. every text becomes a set of prefix n-grams: winnowed 12-grams, and for short texts the
   five-character runs themselves, for which the prefix bound is exact;
2. frequencies of all n-grams of all texts are counted into a table of 2**bits counters in log
   steps, as many as the texts have n-grams up to the greatest table (64 MB); beyond it collisions
   blur the order and keep single n-grams, which costs time but loses no pair;
3. n-grams are ordered rare first, the prefix of each text is kept, n-grams that occur once
   are dropped (nobody can share them), and postings meet on their n-gram;
4. length, positional and suffix filters act inside the n-gram's group. The suffix filter
   compares 128-bit one-permutation sketches of the run sets (four sigma below threshold);
5. each surviving pair is verified once, exactly, on the whole texts.

Equal folded texts are one class and meet nobody inside it; frequent n-grams are split
into block pairs, so no group of postings is unbounded. Long texts rely on prefixes for an
n-gram overlap of ``overlap``. Single edits spread evenly are the worst case: at an agreement of
0.7 they lie 28 characters apart, so 16 of 28 12-grams are shared, 0.57 of all; the overlap of
0.3 leaves room for the chance of winnowing. Measured recall by agreement is in the README.

Defined cases: rows with null or blank content, a null id or a null seq are left out; a null title is
empty; an id delivered again counts once, with its first row; texts under five letters or
digits match nobody but their exact copies with the same, non-empty form.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._store import Scratch

GRAM, WINDOW = 12, 10
SHORT, LONG = 160, 100  # five-character runs: at most SHORT use exact prefixes, over LONG use winnowed ones
BITS = (20, 26)  # log2 of the least and the most counters; between them, one for every eight characters
CHUNK = 18  # log2 of the counters in one stored piece of the table
ROWS = 20_000  # texts whose postings one task meets, about 30 MB
BLOCK = 4096  # postings of one n-gram that meet in one group
SKETCH = 128
CLASS_BLOCK = 1000  # items of one class that meet in one group
POSTING = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("runs", "<u4"), ("pos", "<u2"), ("n", "<u2"), ("s0", "<u8"), ("s1", "<u8")])


def _sketches(runs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two words a text: in each of 128 hash ranges, one bit of the least run hash."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    out = np.zeros((len(ends) - 1, 2), dtype=np.uint64)
    if not len(runs):
        return out
    cell = (runs >> np.uint64(57)).astype(np.int64)
    first = np.concatenate([[True], (cell[1:] != cell[:-1]) | (text[1:] != text[:-1])])
    bit = (runs[first] >> np.uint64(7)) & np.uint64(1)
    c, t = cell[first], text[first]
    np.bitwise_or.at(out, (t, c >> 6), bit << (c & 63).astype(np.uint64))
    return out


def _grams(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs with their ends; prefix n-grams, the text and kind (0 exact, 1 winnowed) of each."""
    runs, ends = tx.distinct_sorted(*tx.grams_by_text(tx.gram_hashes(code, tx.RUN), off, tx.RUN))
    n = np.diff(ends)
    wide, at = tx.winnowed(code, off, GRAM, WINDOW)
    text = np.repeat(np.arange(len(n)), np.diff(at))
    keep = n[text] > LONG
    short = np.repeat(n <= SHORT, n)
    grams = np.concatenate([runs[short], wide[keep] ^ np.uint64(0x5851F42D4C957F2D)])
    owner = np.concatenate([np.repeat(np.arange(len(n)), n)[short], text[keep]])
    kind = np.concatenate([np.zeros(int(short.sum()), dtype=np.int8), np.ones(int(keep.sum()), dtype=np.int8)])
    return runs, ends, grams, owner, kind


def _doc_hashes(code: np.ndarray, off: np.ndarray) -> np.ndarray:
    flat = memoryview(np.ascontiguousarray(code)).cast("B")
    return np.fromiter((xxhash.xxh3_64_intdigest(flat[4 * off[i] : 4 * off[i + 1]]) for i in range(len(off) - 1)), dtype=np.uint64, count=len(off) - 1).astype(np.int64)


def _survey(bits: int):
    """Rows (seq, doc) of every text, and (chunk, slots, counts) of all its n-grams."""

    def run(batches):
        held, size = [], 0

        def flush():
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(slots, np.arange((1 << (bits - CHUNK)) + 1) << CHUNK)
            parts = [(c, slots[a:b], counts[a:b]) for c, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(parts), pa.int64()),
                    pa.nulls(len(parts), pa.int64()),
                    pa.array([c for c, _, _ in parts], pa.int32()),
                    pa.array([(s & ((1 << CHUNK) - 1)).astype("<u4").tobytes() for _, s, _ in parts], pa.binary()),
                    pa.array([np.minimum(n, 0xFFFF).astype("<u2").tobytes() for _, _, n in parts], pa.binary()),
                ],
                names=["seq", "doc", "chunk", "slots", "counts"],
            )

        for batch in batches:
            texts = batch.column("text").to_pylist()
            seq = batch.column("seq").to_numpy(zero_copy_only=False)
            for s, e in tx.blocks(texts):
                code, off = tx.fold_batch(texts[s:e])
                docs = _doc_hashes(code, off)
                docs[np.diff(off) == 0] = 0
                yield pa.RecordBatch.from_arrays([pa.array(seq[s:e]), pa.array(docs), pa.nulls(e - s, pa.int32()), pa.nulls(e - s, pa.binary()), pa.nulls(e - s, pa.binary())], names=["seq", "doc", "chunk", "slots", "counts"])
                _, _, grams, _, _ = _grams(code, off)
                held.append((grams >> np.uint64(64 - bits)).astype(np.int64))
                size += len(grams)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for none, then one plus eight times the binary logarithm: 1 means one occurrence."""
    return np.where(counts > 0, 1 + np.round(8 * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)


def _sum_chunks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, s, n in zip(*(batch.column(x).to_pylist() for x in ("chunk", "slots", "counts"))):
            table = total.setdefault(c, np.zeros(1 << CHUNK, dtype=np.int64))
            table[np.frombuffer(s, dtype="<u4")] += np.frombuffer(n, dtype="<u2")
    for c, table in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([_levels(table).tobytes()], pa.binary())], names=["chunk", "levels"])


def _scatter(keys: np.ndarray, rows: np.ndarray, slices: int):
    """One record batch with the rows of each slice of the key space as one value."""
    part = (keys % np.uint64(slices)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(slices + 1))
    rows = rows[order]
    ids = [i for i in range(slices) if cut[i + 1] > cut[i]]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([rows[cut[i] : cut[i + 1]].tobytes() for i in ids], pa.binary())], names=["slice", "rows"])


def _post(levels, bits: int, threshold: float, overlap: float, slices: int, block: int):
    def run(batches):
        table = levels.value
        held, size = [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in tx.blocks(texts):
                code, off = tx.fold_batch(texts[s:e])
                docs = _doc_hashes(code, off)
                runs, ends, grams, owner, kind = _grams(code, off)
                if not len(grams):
                    continue
                again = np.ones(e - s, dtype=bool)
                again[np.unique(docs, return_index=True)[1]] = False
                level = table[(grams >> np.uint64(64 - bits)).astype(np.int64)]
                group = owner.astype(np.int64) * 2 + kind
                order = np.lexsort((grams, level, group))
                grams, level, group = grams[order], level[order], group[order]
                n = np.bincount(group, minlength=2 * (e - s))
                pos = np.arange(len(group)) - (np.cumsum(n) - n)[group]
                need = np.ceil(np.where(np.arange(len(n)) % 2 == 0, threshold, overlap) * n - 1e-9)
                keep = (pos < (n - need + 1)[group]) & (level != 1) & ~again[group // 2]
                grams, level, group, pos = grams[keep], level[keep], group[keep], pos[keep]
                sketch = _sketches(runs, ends)
                text = group // 2
                rows = np.empty(len(grams), dtype=POSTING)
                rows["gram"], rows["doc"], rows["runs"] = grams, docs[text], np.diff(ends)[text]
                rows["pos"], rows["n"] = np.minimum(pos, 0xFFFF), np.minimum(n[group], 0xFFFF)
                rows["s0"], rows["s1"] = sketch[text, 0], sketch[text, 1]
                parts = np.ceil(np.exp2((level.astype(np.float64) - 1) / 8) * 1.1 / block).astype(np.int64)
                if parts.max(initial=1) > 1:
                    rows = _split(rows, parts)
                held.append(rows)
                size += len(rows)
                if size > 1_500_000:
                    rows = np.concatenate(held)
                    yield _scatter(rows["gram"], rows, slices)
                    held, size = [], 0
        if size:
            rows = np.concatenate(held)
            yield _scatter(rows["gram"], rows, slices)

    return run


def _split(rows: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Postings of frequent n-grams, once for each pair of blocks that has theirs."""
    out = [rows[parts <= 1]]
    for p in np.unique(parts[parts > 1]).tolist():
        mine = rows[parts == p]
        own = (mine["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(p)
        for other in range(p):
            copy = mine.copy()
            low, high = np.minimum(own, np.uint64(other)), np.maximum(own, np.uint64(other))
            copy["gram"] = tx._joined(tx._joined(mine["gram"], low), high)
            out.append(copy)
    return np.concatenate(out)


def _meet(threshold: float, overlap: float, most: int = 2_000_000):
    """Candidate pairs (a < b) of the postings that share an n-gram; each once a slice."""
    p = (1 + threshold) / 2
    unlike = SKETCH * (1 - p) + 4 * np.sqrt(SKETCH * p * (1 - p))

    def pairs(rows: np.ndarray):
        rows = np.unique(rows[np.lexsort((rows["doc"], rows["gram"]))])
        gram = rows["gram"]
        left = np.searchsorted(gram, gram, side="right") - np.arange(len(gram)) - 1
        start, seen = 0, []
        total = np.cumsum(left)
        while start < len(rows):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
            c = left[start:stop]
            i = np.repeat(np.arange(start, stop), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1
            ra, rb = rows["runs"][i], rows["runs"][j]
            ok = np.minimum(ra, rb) >= threshold * np.maximum(ra, rb) - 1e-9  # length
            i, j = i[ok], j[ok]
            na, nb = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64)
            rest = np.minimum(na - rows["pos"][i], nb - rows["pos"][j])
            ok = (rest >= overlap * np.maximum(na, nb) - 1e-9) | (np.maximum(na, nb) >= 0xFFFF)  # positional
            i, j = i[ok], j[ok]
            differ = np.bitwise_count(rows["s0"][i] ^ rows["s0"][j]) + np.bitwise_count(rows["s1"][i] ^ rows["s1"][j])
            ok = (differ <= unlike) & (rows["doc"][i] != rows["doc"][j])  # suffix
            a, b = rows["doc"][i[ok]], rows["doc"][j[ok]]
            seen.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
            start = stop
        found = np.unique(np.concatenate(seen), axis=0) if seen else np.zeros((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["doc_a", "doc_b"])

    def run(batches):
        held = defaultdict(list)
        for batch in batches:
            for s, rows in zip(batch.column("slice").to_pylist(), batch.column("rows").to_pylist()):
                held[s].append(np.frombuffer(rows, dtype=POSTING))
        for s in list(held):
            yield pairs(np.concatenate(held.pop(s)))

    return run


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            da, db = batch.column("doc_a").to_numpy(), batch.column("doc_b").to_numpy()
            for s in range(0, len(a), 1500):
                e = min(s + 1500, len(a))
                place: dict[str, int] = {}
                for t in a[s:e] + b[s:e]:
                    place.setdefault(t, len(place))
                sets = tx.run_sets(list(place))
                score = np.array([tx.agreement(sets[place[x]], sets[place[y]]) for x, y in zip(a[s:e], b[s:e])])
                ok = score >= threshold - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array(da[s:e][ok]), pa.array(db[s:e][ok]), pa.array(score[ok])], names=["doc_a", "doc_b", "agreement"])

    return run


def near_pairs(spark: SparkSession, items: DataFrame, threshold: float = 0.7, overlap: float = 0.3, bits: int | None = None, block: int = BLOCK, store: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """``items`` has (item_id string, seq bigint, text string). Returns (members, pairs): the class
    ``doc`` of every item, and the matching pairs of classes (doc_a < doc_b, agreement)."""
    store = store or Scratch(spark, "nearcopy")
    texts = items.select("seq", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bits is None:
        chars = int(texts.agg(F.sum(F.length("text"))).first()[0] or 0)
        bits = min(max(int(np.ceil(np.log2(chars / 8 + 1))), BITS[0]), BITS[1])
    survey = store.write(texts.mapInArrow(_survey(bits), "seq bigint, doc bigint, chunk int, slots binary, counts binary"), "survey")
    sums = survey.where("chunk is not null").select("chunk", "slots", "counts").repartition(parts, "chunk").mapInArrow(_sum_chunks, "chunk int, levels binary")
    table = np.zeros(1 << bits, dtype=np.uint8)
    for r in sums.toLocalIterator():  # 2**bits bytes in all, whatever the input
        table[r["chunk"] << CHUNK : (r["chunk"] + 1) << CHUNK] = np.frombuffer(r["levels"], dtype=np.uint8)
    levels = spark.sparkContext.broadcast(table)
    parts = max(parts, survey.where("seq is not null").count() // ROWS)
    slices = parts * 8
    posted = texts.mapInArrow(_post(levels, bits, threshold, overlap, slices, block), "slice int, rows binary")
    met = posted.repartition(parts, "slice").mapInArrow(_meet(threshold, overlap), "doc_a bigint, doc_b bigint")
    candidates = store.write(met.distinct(), "candidates")
    first = survey.where("seq is not null and doc <> 0").groupBy("doc").agg(F.min("seq").alias("seq"))
    wanted = candidates.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct().join(first, "doc")
    known = store.write(texts.join(wanted, "seq").select("doc", "text"), "known")
    both = candidates.join(known.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b").join(known.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a")
    pairs = store.write(both.select("doc_a", "doc_b", "text_a", "text_b").mapInArrow(_verify(threshold), "doc_a bigint, doc_b bigint, agreement double"), "pairs")
    levels.unpersist()
    store.drop("known")
    ids = items.select("item_id", "seq").join(survey.where("seq is not null and doc <> 0").select("seq", "doc"), "seq")
    once = ids.groupBy("item_id").agg(F.min(F.struct("seq", "doc")).alias("x")).select("item_id", "x.seq", "x.doc")
    members = store.write(once, "members")
    store.drop("survey")
    return members, pairs


def usable_items(df: DataFrame, item: str = "item_id", seq: str = "seq", title: str | None = "title", content: str = "content") -> DataFrame:
    body = F.col(content)
    text = body if title is None else F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), body)
    return df.where(body.isNotNull() & body.rlike(r"[^\s\p{Z}\x{FEFF}]") & F.col(item).isNotNull() & F.col(seq).isNotNull()).select(F.col(item).alias("item_id"), F.col(seq).cast("bigint").alias("seq"), text.alias("text"))


def item_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of items: those of matching classes and those inside one class. Where copies are many, ``members``
    and ``pairs`` say the same without spelling it out, as does ``groups``."""
    a = members.select(F.col("doc").alias("doc_a"), F.col("item_id").alias("x"))
    b = members.select(F.col("doc").alias("doc_b"), F.col("item_id").alias("y"))
    sizes = members.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / CLASS_BLOCK).cast("int")  # a large class meets itself block by block
    shared = members.join(sizes, "doc").select("doc", "item_id", blocks.alias("blocks"), F.pmod(F.xxhash64("item_id"), blocks).cast("int").alias("own"))
    left = shared.select("doc", F.col("item_id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    same = left.join(shared.select("doc", "own", F.col("item_id").alias("y")), ["doc", "own"]).where("x < y").select("x", "y")
    across = pairs.select("doc_a", "doc_b").join(a, "doc_a").join(b, "doc_b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return same.unionByName(across).select(F.col("x").alias("item_id_a"), F.col("y").alias("item_id_b"))


def groups(spark: SparkSession, members: DataFrame, pairs: DataFrame, store: Scratch | None = None) -> DataFrame:
    """(item_id, group_id, n_links): connected classes by alternating min-label hooking; the label is
    the group's least class. Each round halves the height of the trees and is written, so the
    lineage stays short; links are those to other texts."""
    store = store or Scratch(spark, "groups")
    links = pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).unionByName(pairs.select(F.col("doc_b").alias("u"), F.col("doc_a").alias("v")))
    edges = store.write(links, "edges")
    label = store.write(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "label=0")
    step = 0
    while True:
        step += 1
        near = edges.join(label.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        hooked = label.join(near, "u").select("u", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jumped = hooked.join(label.select(F.col("u").alias("root"), F.col("root").alias("up")), "root", "left").select("u", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        now = store.write(jumped, f"label={step}")
        changed = now.where("old <> root").limit(1).count()
        label = now.select("u", "root")
        if step > 1:
            store.drop(f"label={step - 1}")
        if not changed:
            break
    degree = edges.groupBy("u").agg(F.count("*").alias("n"))
    who = members.join(label.join(degree, "u").select(F.col("u").alias("doc"), "root", "n"), "doc", "left")
    copies = Window.partitionBy("group_id")
    out = who.select("item_id", F.coalesce("root", "doc").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
    return out.withColumn("n_items", F.count("*").over(copies)).where("n_items > 1")
