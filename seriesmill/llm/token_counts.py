"""Exact token counts at every prefix of a text, for truncation and budgets.

Counts come from dynamic programming over prefixes (`word_bpe.PrefixCounter`), kept per piece and reused, so neither a truncation nor a budget needs a second encoding. Null texts count as empty. Empty texts have no tokens and no prefixes. Repeated rows give repeated results, in an empty table's case none. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_bpe import prefix_counter


def count_tokens(docs: DataFrame, tokenizer: str, budget: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit, fitting_chars): UTF-8 bytes, tokens, whether they exceed the budget, and the characters of the longest prefix within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [counter.tokens(x) for x in texts]
            fit = [len(x) if k <= budget else counter.fitting(x, budget) for x, k in zip(texts, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(fit, pa.int64())], ["id", "n_bytes", "n_tokens", "fitting_chars"])

    ids = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.coalesce(F.octet_length(text_column), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = source.mapInArrow(run, f"id {ids}, n_bytes bigint, n_tokens bigint, fitting_chars bigint")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "fitting_chars")


def prefix_token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, prefix_tokens): the exact number of tokens of each prefix of the text, by its length in characters from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                counts = pa.array([counter.prefixes(text or "")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), counts], ["id", "prefix_tokens"])

    ids = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id {ids}, prefix_tokens array<int>").withColumnRenamed("id", id_column)
