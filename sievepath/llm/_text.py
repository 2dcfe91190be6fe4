"""Vectorised text primitives of the near-duplicate operators.

Agreement of two texts is the Jaccard similarity of their distinct runs of five
characters, taken from the text in NFKC, lower case, letters and digits only.
Everything here works on whole batches of texts laid end to end as code points,
so the Python cost is a few array passes a batch and not a call per character.
"""

from __future__ import annotations

import unicodedata

import numpy as np

RUN = 5
_DROP, _SLOW = 0, 0xFFFFFFFF
_MIX = np.uint64(0x9E3779B97F4A7C15)
_table: np.ndarray | None = None
_astral: dict[int, int] = {}


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def _char_code(cp: int) -> int:
    """The code point that ``cp`` becomes, _DROP, or _SLOW if only the whole text can tell."""
    if 0xD800 <= cp <= 0xDFFF:
        return _DROP
    c = chr(cp)
    if 0x1100 <= cp <= 0x11FF or c == "Σ":
        return _SLOW
    out = unicodedata.normalize("NFKC", c)
    if any(unicodedata.category(x)[0] == "M" for x in c + out):
        return _SLOW
    kept = [x for x in out.lower() if x.isalnum()]
    return _DROP if not kept else ord(kept[0]) if len(kept) == 1 else _SLOW


def _bmp() -> np.ndarray:
    global _table
    if _table is None:
        _table = np.fromiter((_char_code(i) for i in range(0x10000)), dtype=np.uint32, count=0x10000)
    return _table


def fold(text: str | None) -> str:
    """One text in the form in which agreement is measured."""
    return _folded(text or "")


def fold_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all folded texts end to end, and the offsets (one more than texts)."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lens)])
    table = _bmp()
    high = raw >= 0x10000
    if high.any():
        code = table[np.where(high, 0, raw)]
        seen, back = np.unique(raw[high], return_inverse=True)
        for cp in seen.tolist():
            if cp not in _astral:
                _astral[cp] = _char_code(cp)
        code[high] = np.array([_astral[c] for c in seen.tolist()], dtype=np.uint32)[back]
    else:
        code = table[raw]
    slow = np.flatnonzero(code == _SLOW)
    if len(slow):
        docs = np.unique(np.searchsorted(starts, slow, side="right") - 1)
        texts = list(texts)
        for d in docs.tolist():
            texts[d] = _folded(texts[d])
        again = set(docs.tolist())
        parts, sizes, last = [], np.zeros(len(texts), dtype=np.int64), 0
        for d in docs.tolist():
            if last < d:
                parts.append(code[starts[last] : starts[d]])
            parts.append(np.frombuffer(texts[d].encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
            last = d + 1
        parts.append(code[starts[last] :])
        for d in range(len(texts)):
            sizes[d] = len(texts[d]) if d in again else lens[d]
        code = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum(sizes)])
    keep = code != _DROP
    kept = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], kept[starts]


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the run of ``n`` code points that starts at each place."""
    if len(code) < n:
        return np.zeros(0, dtype=np.uint64)
    c = code.astype(np.uint64)
    size = len(c) - n + 1
    h = np.full(size, n, dtype=np.uint64)
    for i in range(n):
        h ^= c[i : i + size]
        h *= _MIX
        h ^= h >> np.uint64(31)
    return h


def grams_by_text(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that lie inside one text, and offsets of each text among them."""
    lens = np.diff(offsets)
    counts = np.maximum(lens - n + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if not len(hashes):
        return hashes, ends
    place = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], counts)
    return hashes[place], ends


def distinct_sorted(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment, and their offsets."""
    out, sizes = [], np.zeros(len(ends) - 1, dtype=np.int64)
    for i in range(len(ends) - 1):
        part = np.sort(values[ends[i] : ends[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        out.append(part)
        sizes[i] = len(part)
    return (np.concatenate(out) if out else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def run_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct run hashes of each text."""
    code, off = fold_batch(texts)
    h, ends = grams_by_text(gram_hashes(code, RUN), off, RUN)
    flat, at = distinct_sorted(h, ends)
    return [flat[at[i] : at[i + 1]] for i in range(len(texts))]


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct arrays; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def blocks(texts: list[str], most: int = 1_000_000):
    """Index ranges that hold at most about ``most`` characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0xD6E8FEB86659FD93) + b
    h ^= h >> np.uint64(32)
    return h * _MIX


def long_gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """As gram_hashes, by doubling: a few array passes whatever ``n`` is."""
    size = len(code) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = _joined(code.astype(np.uint64), np.uint64(n))
    done, out, width = 0, None, 1
    while n:
        if n & 1:
            part = power[done : done + size]
            out = part if out is None else _joined(out, part)
            done += width
        n >>= 1
        if n:
            power = _joined(power[:-width], power[width:])
            width *= 2
    return out ^ (out >> np.uint64(29))


def winnowed(code: np.ndarray, offsets: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of each text: the least n-gram hash of every ``window``
    consecutive ones, so any shared run of n + window - 1 characters shares one. Texts with
    fewer n-grams than a window keep their least one."""
    grams, ends = grams_by_text(long_gram_hashes(code, n), offsets, n)
    low, width = grams, 1
    while width < window:
        step = min(width, window - width)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        width += step
    counts = np.diff(ends)
    full = np.maximum(counts - window + 1, 0)
    at = np.concatenate([[0], np.cumsum(full)])
    place = np.arange(at[-1]) + np.repeat(ends[:-1] - at[:-1], full)
    values = low[place] if len(place) else grams[:0]
    text = np.repeat(np.arange(len(counts)), full)
    if len(values) > 1:
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])])
        values, text = values[new], text[new]
    few = np.flatnonzero((counts > 0) & (full == 0))
    if len(few):
        values = np.concatenate([values, np.array([grams[ends[i] : ends[i + 1]].min() for i in few.tolist()], dtype=np.uint64)])
        text = np.concatenate([text, few])
        order = np.argsort(text, kind="stable")
        values, text = values[order], text[order]
    sizes = np.bincount(text, minlength=len(counts)) if len(text) else np.zeros(len(counts), dtype=np.int64)
    return distinct_sorted(values, np.concatenate([[0], np.cumsum(sizes)]))
