"""Sizes in tokens of a public tokenizer (byte-level BPE ranks)."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the ranks; the same on all executors.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed: the pattern that belongs to these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoder(ranks: str = RANKS):
    """Loaded once in a Python worker."""
    if ranks not in _loaded:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[ranks] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _loaded[ranks]


def with_tokens(df: DataFrame, text: str, name: str = "tokens", ranks: str = RANKS) -> DataFrame:
    """df without its text column and with the number of its tokens; 0 for null and empty texts. One map, no shuffle."""
    carried = [c for c in df.columns if c != text]
    if name in carried:
        raise ValueError(f"there is a column {name} already")

    def count(batches):
        encode = encoder(ranks).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(sizes, pa.int64())], names=[*carried, name])

    types = dict(df.dtypes)
    return df.select(*(F.col(f"`{c}`") for c in [*carried, text])).mapInArrow(count, ", ".join([*(f"`{c}` {types[c]}" for c in carried), f"`{name}` long"]))
