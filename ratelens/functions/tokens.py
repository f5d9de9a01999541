"""Sub-word tokens of a given vocabulary file: counts, and arrays of fixed width with masks."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """One for each worker process and file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def subword_count(text: Column, path: str, special: int = 0) -> Column:
    """Tokens of the text by the vocabulary at ``path`` (the same on all workers), and ``special`` further ones; a null text has none of its own."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(path)
        return pd.Series([special + (len(tokenizer.encode(t, add_special_tokens=False).ids) if t else 0) for t in texts])

    return count(text)


def padded_tokens(text: Column, path: str, size: int, pad: int = 0) -> Column:
    """``struct(ids, mask)`` of exactly ``size`` entries: the first tokens, then ``pad`` where the mask is 0."""

    @F.pandas_udf("struct<ids:array<int>,mask:array<int>>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        tokenizer, ids, mask = _tokenizer(path), [], []
        for t in texts:
            own = tokenizer.encode(t, add_special_tokens=False).ids[:size] if t else []
            ids.append(own + [pad] * (size - len(own)))
            mask.append([1] * len(own) + [0] * (size - len(own)))
        return pd.DataFrame({"ids": ids, "mask": mask})

    return encode(text)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors whose mask is 1; zeros where there is none, as the count is at least 1."""
    n = F.greatest(F.aggregate(mask, F.lit(0), lambda s, m: s + m), F.lit(1))
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    own = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(own, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)
