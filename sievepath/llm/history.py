"""New batches against everything accepted before, with a persisted prefix-tree hash forest.

A record repeats an earlier one if both ids read as the same number or their contents agree
to at least ``threshold`` (see ``_text``). The state, in the shared folder, is a forest of
sorted runs: ``trees`` signature permutations, each a sorted array of (key, order), where a
key is the concatenation of ``DEPTH`` min-hash labels, so that a prefix of the key is a range.
A batch is located by binary search in each run. All keys are cut to the longest prefix whose
expected recall at the threshold reaches the target (labels dropped from the end), so each range
is one cut key in the order of the rows. (The earliest repeat is asked for, so a row that a longer
prefix has settled would still have to look under the shorter one; one prefix for all rows is
therefore the whole search.) Its own rows join the forest as a new run, and runs of like size are
merged, so every key is rewritten O(log) times. Each tree is split into ``parts`` by key, one task
and one set of runs each, so the tasks grow in number with the rows and not in size.

The forest lies in a stated folder with a manifest: ``HashForest.open`` takes it up in a new session,
and ``accept_batch`` signs, searches, verifies and merges one batch against it alone.
Two more sorted arrays find equal ids and equal contents exactly; only the first record of
each distinct content enters the trees. Candidates, earliest first, are verified on the whole
texts; a range longer than ``cap`` is continued only for records that its first part has not
settled, until all are.

The work of a batch is its own keys times log(history); texts of the history are only read
for candidates. Files are replaced by rename, so a task that runs again leaves the same state.

Defined cases: null, blank and ``unknown_`` ids, and ids that are no number, identify nothing;
contents under ``shortest`` characters and null contents are not compared; rows with a null
row id are left out and a null batch is batch 0; (batch, row id) is unique; a row that repeats only later rows is no repeat.
"""

from __future__ import annotations

import ast
import json
import os
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as tx
from ._store import Scratch
from .nearcopy import SKETCH, _sketches

GRAM, WINDOW = 9, 4  # short grams in narrow windows: even edits leave half of the labels equal
TREES, DEPTH, LABEL = 32, 3, 16
PER_TASK = 4
ALIKE = 0.51  # mean share of equal labels of evenly edited texts at an agreement of 0.70 to 0.75, the worst spread of edits (measured)
RECALL = 0.985
CAP = 64
ROW_BITS = 44
PART_ROWS = 4_000_000  # rows for each part of a tree
_NUMBER = re.compile(r"\d+\Z")


def id_number(raw: str | None) -> str | None:
    """The number that an id reads as, whatever its blanks and form of digits."""
    if raw is None:
        return None
    text = unicodedata.normalize("NFKC", raw).strip().strip("﻿​")
    return str(int(text)) if len(text) < 4000 and _NUMBER.match(text) else None


def depth_for(recall: float, trees: int = TREES, alike: float = ALIKE) -> int:
    """The longest prefix that reaches the recall; 1 if none does."""
    return next((d for d in range(DEPTH, 1, -1) if 1 - (1 - alike**d) ** trees >= recall), 1)


def _labels(code: np.ndarray, off: np.ndarray, trees: int) -> np.ndarray:
    """Keys (texts x trees)."""
    f, ends = tx.winnowed(code, off, GRAM, WINDOW)
    h = (f >> np.uint64(32)).astype(np.uint32)
    some = np.diff(ends) > 0
    start = ends[:-1][some]
    rng = np.random.default_rng(20240229)
    keys = np.zeros((len(off) - 1, trees), dtype=np.uint64)
    for t in range(trees):
        for _ in range(DEPTH):
            mul, add = (np.uint32(x) for x in rng.integers(1, 1 << 32, size=2, dtype=np.uint64))
            v = h * (mul | np.uint32(1))
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v += add
            least = np.minimum.reduceat(v, start) if len(start) else v[:0]
            label = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - LABEL)
            keys[some, t] = (keys[some, t] << np.uint64(LABEL)) | label
    return keys


def _sign(trees: int, shortest: int):
    groups = trees // PER_TASK

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("content").to_pylist()]
            ids = batch.column("id").to_pylist()
            for s, e in tx.blocks(texts):
                code, off = tx.fold_batch(texts[s:e])
                long = np.fromiter((len(t) >= shortest for t in texts[s:e]), dtype=bool, count=e - s) & (np.diff(off) >= tx.RUN)
                flat = memoryview(np.ascontiguousarray(code)).cast("B")
                same = np.array([xxhash.xxh3_64_intdigest(flat[4 * off[i] : 4 * off[i + 1]]) for i in range(e - s)], dtype=np.uint64).astype(np.int64)
                keys = _labels(code, off, trees)
                runs, ends = tx.distinct_sorted(*tx.grams_by_text(tx.gram_hashes(code, tx.RUN), off, tx.RUN))
                sketch = _sketches(runs, ends).view(np.int64)
                number = [id_number(x) for x in ids[s:e]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ord").slice(s, e - s),
                        batch.column("batch_no").slice(s, e - s),
                        pa.array([None if n is None else xxhash.xxh3_64_intdigest(n) - (1 << 63) for n in number], pa.int64()),
                        pa.array(same, mask=~long),
                        pa.array(sketch[:, 0].copy()),
                        pa.array(sketch[:, 1].copy()),
                    ]
                    + [pa.array([x.tobytes() for x in keys[:, g * PER_TASK : (g + 1) * PER_TASK]], pa.binary()) for g in range(groups)],
                    names=["ord", "batch_no", "id_key", "text_key", "s0", "s1"] + [f"k{g}" for g in range(groups)],
                )

    return run


class _Files:
    """The shared folder as the workers see it."""

    def __init__(self, uri: str):
        if uri.startswith("file:"):
            uri = "file:///" + uri[5:].lstrip("/")
        if uri.startswith(("s3a://", "s3n://")):
            uri = "s3" + uri[3:]
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    def batches(self, name: str, columns: list[str]):
        """The record batches of a table's files, so a reader keeps only what it wants."""
        found = [f.path for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{name}", recursive=True, allow_not_found=True)) if f.path.endswith(".parquet") and f.size]
        for p in sorted(found):
            with self.fs.open_input_file(p) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=1 << 16, columns=columns)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        path = f"{self.root}/{name}"
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(data)
        self.fs.move(draft, path)

    def delete(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.root}/{name}").type != pafs.FileType.NotFound:
            self.fs.delete_file(f"{self.root}/{name}")


FENCE = 512  # entries between two fences


class _Run:
    """A sorted run on disk: keys, orders, then every FENCE-th key; reads only the blocks it needs."""

    def __init__(self, files: _Files, name: str, size: int):
        self.files, self.name, self.size = files, name, size

    @staticmethod
    def store(files: _Files, name: str, keys: np.ndarray, order: np.ndarray) -> None:
        files.write(name, keys.astype("<u8").tobytes() + order.astype("<i8").tobytes() + keys[::FENCE].astype("<u8").tobytes())

    def load(self) -> tuple[np.ndarray, np.ndarray]:
        with self.files.fs.open_input_file(f"{self.files.root}/{self.name}") as f:
            return np.frombuffer(f.read_at(8 * self.size, 0), "<u8"), np.frombuffer(f.read_at(8 * self.size, 8 * self.size), "<i8")

    def ranges(self, low: np.ndarray, high: np.ndarray):
        """For each sorted query the entries with low <= key <= high: (query, order, rank in range, length)."""
        with self.files.fs.open_input_file(f"{self.files.root}/{self.name}") as f:
            fences = np.frombuffer(f.read_at(8 * -(-self.size // FENCE), 16 * self.size), "<u8")
            first = np.maximum(np.searchsorted(fences, low, side="left") - 1, 0)
            last = np.searchsorted(fences, high, side="right")
            start = 0
            while start < len(low):  # neighbouring queries share one read
                stop, end = start + 1, last[start]
                while stop < len(low) and first[stop] <= end and stop - start < 4096:
                    end = max(end, last[stop])
                    stop += 1
                a, b = first[start] * FENCE, min(end * FENCE, self.size)
                if b > a:
                    keys = np.frombuffer(f.read_at(8 * (b - a), 8 * a), "<u8")
                    lo, hi = np.searchsorted(keys, low[start:stop], side="left"), np.searchsorted(keys, high[start:stop], side="right")
                    if (hi > lo).any():
                        order = np.frombuffer(f.read_at(8 * (b - a), 8 * self.size + 8 * a), "<i8")
                        yield start, lo, hi, order
                start = stop


def _expand(lo: np.ndarray, hi: np.ndarray, cap: int):
    n = np.minimum(hi - lo, cap)
    q = np.repeat(np.arange(len(lo)), n)
    return q, np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _hits(run: _Run, low, high, ords, cap: int):
    """(query index, earlier order) pairs, and (query index, last order seen) of ranges that go on."""
    for start, lo, hi, order in run.ranges(low, high):
        q, at = _expand(lo, hi, cap)
        o = order[at]
        ok = o < ords[start + q]
        more = np.flatnonzero(hi - lo > cap)
        yield start + q[ok], o[ok], start + more, order[lo[more] + cap - 1] if len(more) else order[:0]


def _runs(state: dict, files: _Files, tree: str) -> list[_Run]:
    return [_Run(files, f"{tree}/{v}.run", n) for v, n in state.get(tree, [])]


def _insert(files: _Files, runs: list[list], tree: str, version: int, keys: np.ndarray, order: np.ndarray, fan: int = 4) -> tuple[list[list], list[str]]:
    """Adds a run and merges as long as ``fan`` runs of like size stand last; returns the new list and dead files."""
    dead: list[str] = []
    runs = [list(r) for r in runs]
    if len(keys):
        parts, size, taken = [(keys, order)], len(keys), []
        while len(runs) - len(taken) > 0:
            tail = [r for r in runs[: len(runs) - len(taken)]]
            like = 0
            while like < len(tail) and tail[-1 - like][1] <= 2 * size:
                like += 1
            if like + 1 < fan:
                break
            for v, n in tail[len(tail) - like :]:
                parts.append(_Run(files, f"{tree}/{v}.run", n).load())
                dead.append(f"{tree}/{v}.run")
                size += n
            taken += tail[len(tail) - like :]
        runs = runs[: len(runs) - len(taken)]
        keys, order = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        by = np.lexsort((order, keys))
        _Run.store(files, f"{tree}/{version}.run", keys[by], order[by])
        runs.append([version, len(keys)])
    return runs, dead


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)


def _joined(pieces: list, kind: type) -> np.ndarray:
    return np.concatenate(pieces) if pieces else np.zeros(0, dtype=kind)


def _exact_task(root: str, state: dict, version: int, parts: int):
    """Earliest equal id and equal text of each row of a batch, and the two sorted arrays renewed, part by part."""

    def run(batches):
        files = _Files(root)
        for batch in batches:
            for task in batch.column("task").to_pylist():
                kind, part = task.split(".")
                found_k, found_o = [], []
                for b in files.batches(f"signed/batch_no={version}", ["ord", kind]):
                    b = b.filter(b.column(kind).is_valid())
                    k, o = b.column(kind).to_numpy(zero_copy_only=False).view(np.uint64), b.column("ord").to_numpy(zero_copy_only=False)
                    mine = _part(k, parts) == int(part)
                    found_k.append(k[mine])
                    found_o.append(o[mine])
                keys, ords = _joined(found_k, np.uint64), _joined(found_o, np.int64)
                by = np.lexsort((ords, keys))
                keys, ords = keys[by], ords[by]
                new = np.ones(len(keys), dtype=bool)
                if len(keys):
                    new[1:] = keys[1:] != keys[:-1]
                head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, dtype=np.int64)
                first = ords[head]
                for r in _runs(state, files, task):
                    for q, o, _, _ in _hits(r, keys, keys, ords, 1):
                        np.minimum.at(first, q, o)
                fresh = new & (first == ords)
                runs, dead = _insert(files, state.get(task, []), task, version, keys[fresh], ords[fresh])
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(ords)), pa.array(ords), pa.array(first)], names=["kind", "ord", "first"])
                files.write(f"{task}/{version}.state", repr([(task, runs, dead)]).encode())

    return run


def _near_task(root: str, state: dict, version: int, mask: int, cap: int, parts: int):
    def run(batches):
        files = _Files(root)
        for batch in batches:
            for task in batch.column("task").to_pylist():
                g, part = (int(x) for x in task.split("."))
                firsts = []
                for b in files.batches(f"exact/{version}", ["kind", "ord", "first"]):
                    b = b.filter(pa.compute.and_(pa.compute.equal(b.column("kind"), "text_key"), pa.compute.equal(b.column("ord"), b.column("first"))))
                    firsts.append(b.column("ord").to_numpy(zero_copy_only=False))
                is_new = np.sort(_joined(firsts, np.int64))
                held: list[list] = [[] for _ in range(PER_TASK)]
                for b in files.batches(f"signed/batch_no={version}", ["ord", f"k{g}"]):
                    every = b.column("ord").to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(is_new, every), max(len(is_new) - 1, 0))
                    use = is_new[at] == every if len(is_new) else np.zeros(len(every), dtype=bool)
                    raw = b.column(f"k{g}").filter(pa.array(use)).to_pylist()
                    keys = np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1) if raw else np.zeros((0, PER_TASK), "<u8")
                    for t in range(PER_TASK):
                        k = keys[:, t] & np.uint64(mask)
                        mine = _part(k, parts) == part
                        held[t].append(np.stack([k[mine].view(np.int64), every[use][mine]]))
                pairs, more, log = [], [], []
                for t in range(PER_TASK):
                    tree = f"tree{g * PER_TASK + t}.{part}"
                    both = np.concatenate(held[t], axis=1) if held[t] else np.zeros((2, 0), dtype=np.int64)
                    held[t] = []
                    k, o = both[0].view(np.uint64), both[1]
                    by = np.lexsort((o, k))
                    k, o = k[by], o[by]
                    _search(_runs(state, files, tree), k, o, cap, pairs, more, own=True)
                    runs, dead = _insert(files, state.get(tree, []), tree, version, k, o)
                    log.append((tree, runs, dead))
                yield _found(pairs, more)
                files.write(f"{task}/{version}.state", repr(log).encode())

    return run


def _search(runs: list[_Run], keys, ords, cap: int, pairs: list, more: list, own: bool) -> None:
    """``keys`` are cut and sorted, equal ones by order, as in the runs: the last order seen bounds the rest."""
    for r in runs:
        for q, o, m, last in _hits(r, keys, keys, ords, cap):
            pairs.append(np.stack([o, ords[q]], axis=1))
            more.append(np.stack([last, ords[m]], axis=1))
    if own and len(keys):
        lo, hi = np.searchsorted(keys, keys, side="left"), np.searchsorted(keys, keys, side="right")
        q, at = _expand(lo, hi, cap)
        o = ords[at]
        ok = o < ords[q]
        pairs.append(np.stack([o[ok], ords[q[ok]]], axis=1))
        m = np.flatnonzero(hi - lo > cap)
        more.append(np.stack([ords[lo[m] + cap - 1], ords[m]], axis=1))


def _found(pairs: list, more: list) -> pa.RecordBatch:
    none = np.zeros((0, 2), dtype=np.int64)
    p = np.unique(np.concatenate([none, *pairs]), axis=0)
    m = np.unique(np.concatenate([none, *more]), axis=0)
    m = m[m[:, 0] < m[:, 1]]
    both = np.concatenate([p, m])
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.arange(len(both)) >= len(p))], names=["cand", "ord", "open"])


def _again_task(root: str, state: dict, mask: int, cap: int, parts: int):
    """Unsettled rows against the whole forest, with a longer cap; their keys come with the rows."""

    def run(batches):
        files = _Files(root)
        for batch in batches:
            ords, group = batch.column("ord").to_numpy(), batch.column("group").to_pylist()
            blob = batch.column("keys").to_pylist()
            pairs, more = [], []
            for g in sorted(set(group)):
                mine = [i for i, x in enumerate(group) if x == g]
                keys = np.frombuffer(b"".join(blob[i] for i in mine), "<u8").reshape(len(mine), -1)
                for t in range(keys.shape[1]):
                    k = keys[:, t] & np.uint64(mask)
                    by = np.lexsort((ords[mine], k))
                    k, o = k[by], ords[mine][by]
                    where = _part(k, parts)
                    for p in np.unique(where).tolist():
                        _search(_runs(state, files, f"tree{g * PER_TASK + t}.{p}"), k[where == p], o[where == p], cap, pairs, more, own=False)
            yield _found(pairs, more)

    return run


class HashForest:
    """The state over one shared folder; ``state`` maps each part of a tree to its runs [version, size]."""

    def __init__(self, spark: SparkSession, store: Scratch, trees: int = TREES, recall: float = RECALL, cap: int = CAP, parts: int = 1, state: dict | None = None, versions: list[int] | None = None, settled: list[str] | None = None):
        self.spark, self.store, self.trees, self.recall, self.cap, self.parts = spark, store, trees, recall, cap, parts
        self.groups = trees // PER_TASK
        drop = LABEL * (DEPTH - depth_for(recall, trees))
        self.mask = ((1 << 64) - 1) >> drop << drop
        self.state: dict[str, list] = state or {}
        self.versions: list[int] = versions or []
        self.settled: list[str] = settled or []  # tables of (ord, near), one for each call that settled batches

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> HashForest:
        """The forest that an earlier session left in the folder."""
        store = Scratch.at(spark, folder)
        return cls(spark, store, **json.loads(_Files(store.root).read("forest.json")))

    def save(self) -> None:
        """Replaces the manifest by rename; until then the old one holds."""
        said = {"trees": self.trees, "recall": self.recall, "cap": self.cap, "parts": self.parts, "state": self.state, "versions": self.versions, "settled": self.settled}
        _Files(self.store.root).write("forest.json", json.dumps(said).encode())

    def _tasks(self, names: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([(i, v) for i, v in enumerate(names)], "at int, task string")
        return rows.repartitionByRange(len(names), "at").select("task")

    def _learn(self, names: list[str], version: int) -> None:
        files = _Files(self.store.root)
        for n in names:
            for tree, runs, dead in ast.literal_eval(files.read(f"{n}/{version}.state").decode()):
                self.state[tree] = runs
                for d in dead:
                    files.delete(d)

    def accept(self, version: int) -> tuple[DataFrame, DataFrame]:
        """Batch ``version`` (signed before): exact repeats, near candidates; the batch joins the state."""
        kinds = [f"{k}.{p}" for k in ("id_key", "text_key") for p in range(self.parts)]
        exact = self.store.write(self._tasks(kinds).mapInArrow(_exact_task(self.store.root, dict(self.state), version, self.parts), "kind string, ord bigint, first bigint"), f"exact/{version}")
        self._learn(kinds, version)
        groups = [f"{g}.{p}" for g in range(self.groups) for p in range(self.parts)]
        near = self.store.write(self._tasks(groups).mapInArrow(_near_task(self.store.root, dict(self.state), version, self.mask, self.cap, self.parts), "cand bigint, ord bigint, open boolean"), f"near/{version}")
        self._learn(groups, version)
        self.versions.append(version)
        return exact, near

    def shape(self) -> str:
        return "ord bigint, batch_no int, id_key bigint, text_key bigint, s0 bigint, s1 bigint, " + ", ".join(f"k{g} binary" for g in range(self.groups))


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            x, y = batch.column("cand").to_numpy(), batch.column("ord").to_numpy()
            for s in range(0, len(a), 1500):
                e = min(s + 1500, len(a))
                place: dict[str, int] = {}
                for t in a[s:e] + b[s:e]:
                    place.setdefault(t, len(place))
                sets = tx.run_sets(list(place))
                ok = np.array([tx.agreement(sets[place[p]], sets[place[q]]) >= threshold - 1e-12 for p, q in zip(a[s:e], b[s:e])])
                yield pa.RecordBatch.from_arrays([pa.array(x[s:e][ok]), pa.array(y[s:e][ok])], names=["cand", "ord"])

    return run


def _settle(forest: HashForest, texts: DataFrame, near: DataFrame, threshold: float, name: str) -> DataFrame:
    """Verified (cand, ord) pairs of candidates. Before a text is read for a pair, the 128-bit sketches of both must
    agree as those of texts at the threshold do, four sigma less."""
    store = forest.store
    p = (1 + threshold) / 2
    unlike = int(SKETCH * (1 - p) + 4 * (SKETCH * p * (1 - p)) ** 0.5)
    sketches = forest.spark.read.schema("ord bigint, s0 bigint, s1 bigint").parquet(*[store.path(f"signed/batch_no={v}") for v in forest.versions]) if forest.versions else forest.spark.createDataFrame([], "ord bigint, s0 bigint, s1 bigint")
    both = near.where("not open").select("cand", "ord").join(sketches, "ord").join(sketches.select(F.col("ord").alias("cand"), F.col("s0").alias("t0"), F.col("s1").alias("t1")), "cand")
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1")))
    pairs = store.write(both.where(differ <= unlike).select("cand", "ord").distinct(), f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array("cand", "ord")).alias("ord")).distinct()
    known = store.write(texts.join(wanted, "ord"), f"{name}-known")
    both = pairs.join(known.select("ord", F.col("content").alias("text_b")), "ord").join(known.select(F.col("ord").alias("cand"), F.col("content").alias("text_a")), "cand")
    out = store.write(both.select("cand", "ord", "text_a", "text_b").mapInArrow(_verify(threshold), "cand bigint, ord bigint"), f"{name}-verified")
    store.drop(f"{name}-known")
    return out


def _ordered(rows: DataFrame) -> DataFrame:
    order = F.coalesce("batch_no", F.lit(0)).cast("bigint") * F.lit(1 << ROW_BITS) + F.col("row_id")
    return rows.where("row_id is not null").select(order.alias("ord"), F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch_no"), "id", "content")


def _resolve(forest: HashForest, texts: DataFrame, versions: list[int], threshold: float, name: str) -> DataFrame:
    """(first_row_id, row_id) of the rows of some accepted batches."""
    spark, store, cap = forest.spark, forest.store, forest.cap
    none = spark.createDataFrame([], "cand bigint, ord bigint, open boolean")
    near = spark.read.schema(none.schema).parquet(*[store.path(f"near/{v}") for v in versions]) if versions else none
    exact = spark.read.schema("kind string, ord bigint, first bigint").parquet(*[store.path(f"exact/{v}") for v in versions]) if versions else spark.createDataFrame([], "kind string, ord bigint, first bigint")
    verified, step, longer = _settle(forest, texts, near, threshold, f"{name}0"), 0, cap
    while True:
        best = verified.groupBy("ord").agg(F.min("cand").alias("best"))
        open_ = near.where("open").groupBy("ord").agg(F.min("cand").alias("seen")).join(best, "ord", "left").where("best is null or best > seen").select("ord")
        unsettled = store.write(open_, f"{name}-open{step}")
        if not unsettled.limit(1).count():
            break
        step, longer = step + 1, longer * 16
        signed = spark.read.schema(forest.shape()).parquet(*[store.path(f"signed/batch_no={v}") for v in versions])
        keyed = signed.join(unsettled, "ord").select("ord", F.posexplode(F.array(*[f"k{g}" for g in range(forest.groups)])).alias("group", "keys"))
        spread = max(forest.groups * forest.parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        more = keyed.repartition(spread, "group", F.pmod(F.xxhash64("ord"), F.lit(forest.parts))).mapInArrow(_again_task(store.root, dict(forest.state), forest.mask, longer, forest.parts), "cand bigint, ord bigint, open boolean")
        near = store.write(more, f"{name}-again{step}")
        verified = verified.unionByName(_settle(forest, texts, near.join(verified.select("cand", "ord"), ["cand", "ord"], "left_anti"), threshold, f"{name}{step}"))
    by_text = store.write(verified.groupBy("ord").agg(F.min("cand").alias("near")), f"settled/{name}")
    if forest.settled:  # a content whose first stands in an older batch repeats what that one repeats
        by_text = by_text.unionByName(spark.read.schema(by_text.schema).parquet(*[store.path(f"settled/{x}") for x in forest.settled]))
    forest.settled.append(name)
    same_text = exact.where("kind = 'text_key'").select("ord", F.col("first").alias("rep"))
    content = same_text.join(by_text.withColumnRenamed("ord", "rep"), "rep", "left").select("ord", F.least(F.col("rep"), F.coalesce("near", "rep")).alias("first"))
    ids = exact.where("kind = 'id_key'").select("ord", "first")
    out = content.unionByName(ids).where("first < ord").groupBy("ord").agg(F.min("first").alias("first"))
    return store.write(out, f"{name}-repeats")


def _plain(repeats: DataFrame) -> DataFrame:
    low = (1 << ROW_BITS) - 1
    return repeats.select(F.col("first").bitwiseAND(F.lit(low)).alias("first_row_id"), F.col("ord").bitwiseAND(F.lit(low)).alias("row_id"))


def accept_batch(forest: HashForest, rows: DataFrame, texts: DataFrame, threshold: float = 0.7, shortest: int = 40) -> DataFrame:
    """One new batch against the kept forest: (first_row_id, row_id) of its repeats. ``rows`` as in replay, all of one
    batch later than those accepted; ``texts``: (row_id, batch_no, content) of everything accepted before, read for
    candidates only. The batch joins the forest, and the manifest is renewed last."""
    new = _ordered(rows)
    found = [r[0] for r in new.select("batch_no").distinct().limit(2).collect()]
    if len(found) > 1 or found and found[0] <= max(forest.versions, default=-1):
        raise ValueError("one batch at a time, later than those accepted")
    if not found:
        return forest.spark.createDataFrame([], "first_row_id bigint, row_id bigint")
    v = found[0]
    forest.store.write(new.mapInArrow(_sign(forest.trees, shortest), forest.shape()), f"signed/batch_no={v}")
    forest.accept(v)
    every = _ordered(texts.withColumn("id", F.lit(None).cast("string"))).unionByName(new).where("content is not null").select("ord", "content")
    out = _resolve(forest, every, [v], threshold, f"batch{v}-")
    forest.save()
    return _plain(out)


def replay(spark: SparkSession, rows: DataFrame, threshold: float = 0.7, shortest: int = 40, trees: int = TREES, recall: float = RECALL, cap: int = CAP, folder: str | None = None) -> DataFrame:
    """``rows``: (row_id bigint, batch_no int, id string, content string). Feeds the batches in order and returns
    (first_row_id, row_id) of every row that repeats an earlier one. With a ``folder`` the forest stays there for
    later batches; else it ends with the call."""
    store = Scratch.at(spark, folder) if folder else Scratch(spark, "history")
    fed = _ordered(rows)
    n = fed.count()
    forest = HashForest(spark, store, trees, recall, cap, parts=-(-n // PART_ROWS) or 1)
    shape = forest.shape()
    signed = store.write(fed.mapInArrow(_sign(trees, shortest), shape), "signed", by="batch_no")
    versions = [r[0] for r in signed.select("batch_no").distinct().orderBy("batch_no").collect()]
    for v in versions:
        forest.accept(v)
    out = _resolve(forest, fed.where("content is not null").select("ord", "content"), versions, threshold, "round")
    if folder:
        forest.save()
        return _plain(out)
    done = store.write(_plain(out), "repeats")
    store.drop("signed")
    for tree in [*forest.state]:
        store.drop(tree)
    return done
