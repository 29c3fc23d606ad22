"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split pattern published with this family of vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, text: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``documents`` without ``text`` and with ``tokens``, the size of the whole text; null and empty texts have 0."""
    kept = [f for f in documents.schema.fields if f.name not in (text, "tokens")]
    columns = [f.name for f in kept]

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(ranks_path)
        for pdf in batches:
            out = pdf[columns].copy()
            out["tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens long"
    return documents.select(*columns, text).mapInPandas(sizes, schema)
