"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter and is read where the work is done."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the usual pattern of byte-level vocabularies: contractions, words, figures, signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, text: str, out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``documents`` with the number of tokens of the whole text; null and empty texts have 0. Replaces a column ``out``."""

    @F.pandas_udf("long")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(path)
        for values in texts:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in values], dtype="int64")

    return documents.withColumn(out, size(F.col(text)))
