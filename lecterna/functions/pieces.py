"""Word pieces by a public tokenizer's model file, which the caller names; the
tokenizer is built once on each worker."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def tokenizer(path: str):  # noqa: ANN201
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encoded(text: Column, path: str, *, end: int | None = None) -> Column:
    """Ids of the pieces of a text, with ``end`` behind them; null stays null."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([None if x is None else t.encode(x, num_threads=1) + ([end] if end is not None else []) for x in s])

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of piece ids; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([None if x is None else t.decode([int(i) for i in x]) for x in s])

    return run(ids)
