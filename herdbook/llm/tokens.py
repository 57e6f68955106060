"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary lies, on the driver and on each executor; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: how byte-level BPE splits a text into words before merging (public pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for null and ''. Special tokens' strings count as ordinary text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def size(text: str | None) -> int:
            return len(coder.encode_ordinary(text)) if text else 0

        for batch in batches:
            yield batch.map(size).astype("int32")

    return count(text)
