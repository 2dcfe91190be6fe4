"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("SIEVEPATH_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published split pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoding(path: str = VOCABULARY):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def counts(texts: list[str | None], path: str = VOCABULARY) -> list[int]:
    """0 for null and empty texts."""
    enc = encoding(path)
    return [len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in texts]


def with_counts(df: DataFrame, text: str, path: str = VOCABULARY) -> DataFrame:
    """``df`` without its text and with ``n_tokens``; an own column of that name is replaced."""
    keep = [c for c in df.columns if c not in (text, "n_tokens")]
    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"

    def run(batches):
        for batch in batches:
            n = counts(batch.column(text).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, shape)
