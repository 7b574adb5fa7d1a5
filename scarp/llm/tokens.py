"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; a parameter of all operators that count tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: the split pattern that the public byte-level vocabularies were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_LOADED: dict = {}


def encoder(path: str):
    """The tokenizer, loaded once per Python worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_tokens) of every non-empty text, whole; null and empty texts give no row."""
    columns = [key, *keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        for batch in batches:
            sizes = [len(codec.encode_ordinary(t)) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sizes, pa.int64())], [*columns, "n_tokens"])

    source = docs.where((F.col(text) != "") & F.col(key).isNotNull()).select(*columns, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(count, f"{schema}, n_tokens long")
