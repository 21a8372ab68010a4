"""Token counts by heap-and-linked-list byte-pair merging: a text's count is its initial symbols minus its merges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

_counters: dict[str, bpe.Counter] = {}  # of a worker, by vocabulary file; outlives a task


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens of each whole text in column `out` (long).

    The driver reads the vocabulary file (50k merges) and broadcasts it. Null and empty texts have 0 tokens; white space
    and repeated rows count like any text; an existing column `out` is replaced; an empty table stays empty.
    """
    merges = docs.sparkSession.sparkContext.broadcast(bpe.Merges.read(vocabulary))

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counters.get(vocabulary)
        if counter is None:
            counter = _counters[vocabulary] = bpe.Counter(merges.value)
        for part in parts:
            yield pd.Series([counter.count(t) for t in part], dtype="int64")

    return docs.withColumn(out, counted(F.col(text)))


def token_report(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit: a row for each row of `docs`, whatever its other columns are."""
    counted = count_tokens(docs.select("doc_id", "text"), vocabulary)
    return counted.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
