"""Problem 8: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bpe import encoder, vocabulary

#: Characters of text that are encoded at once; only memory depends on it.
SLICE_CHARS = 4_000_000


def slices(column: pa.Array):
    """Runs of a string column as (first row, list), each of about SLICE_CHARS characters."""
    at, texts, chars = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py()
        texts.append(text)
        chars += len(text or "")
        if chars >= SLICE_CHARS:
            yield at, texts
            at, texts, chars = i + 1, [], 0
    if texts:
        yield at, texts


def encode_texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key`` and ``ids`` of each row; null and empty texts give an empty list.

    One pass without a shuffle. Special tokens' strings in a text are ordinary
    text. Rows are kept as they are: repeated rows come out repeatedly, null
    keys stay null. Other columns are not read.
    """

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, ends = enc.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key`` and ``n_tokens`` of each row; 0 for null and empty texts."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(enc.counts(texts))], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary())


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, ids and distinct ids by language as stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    ids = p8_ids(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    n = ids.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"))
    # distinct ids of a document first, so that few rows travel
    some = ids.select("lang", F.explode(F.array_distinct("ids")).alias("i")).groupBy("lang", "i").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("distinct_ids"))
    return n.join(some, n["lang"].eqNullSafe(some["lang"]), "left").select(n["lang"], "documents", "tokens", F.coalesce("distinct_ids", F.lit(0)).alias("distinct_ids"))


QUERIES = {"p8_ids": p8_ids, "p8_counts": p8_counts}
ORACLE: dict[str, str] = {}
