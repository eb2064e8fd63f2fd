"""Problem 6: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .bpe import encoder, vocabulary_path


def token_ids(text: Column, path: str | None = None) -> Column:
    """ids ARRAY<INT> of a text column. Null and empty texts give an empty array; strings that look like special tokens are ordinary text."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield pd.Series([e.ids(x) for x in s], dtype=object)

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of ids of a text column; 0 for null and empty texts."""
    path = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield pd.Series([len(e.ids(x)) for x in s], dtype="int64")

    return count(text)


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids), one row for every row of documents, also for repeated texts and null ids. A narrow plan: scan, Arrow, no shuffle; whole texts of any length."""
    return spread(documents.select("doc_id", "text")).select("doc_id", token_ids(F.col("text"), path).alias("ids"))
