"""Document sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.session import tokenizer_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# The split pattern that belongs to these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer in a rank file; read once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, columns: dict[str, Column], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The named columns with ``tokens``, the size of each text (0 for null and empty texts)."""
    path = vocabulary or os.path.join(tokenizer_dir(), VOCABULARY)
    base = docs.select(*[c.alias(n) for n, c in columns.items()], F.col(text).alias("_text"))

    def count(batches):
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(count, f"{kinds}, tokens long")
