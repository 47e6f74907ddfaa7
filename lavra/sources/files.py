"""Sources and sinks: gold questions as CSV, runs as JSON lines, uploads as files, vectors as blobs."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold

#: The columns of a gold set, in file order, and the folded words for an unanswerable question.
GOLD_COLUMNS = ["id", "workspace", "topic", "nivel", "question", "expected_item", "expected_document", "expected_values", "expected_answer", "answerable"]
UNANSWERABLE = ["nao", "no", "false", "0", "n"]
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions of a CSV file or folder: names in any case, rows of blanks only left out.

    A missing column is null; ``expected_values`` becomes an array split at
    bars; a blank ``answerable`` means yes. Raises on a blank id or question and
    on an id that occurs twice.
    """
    raw = spark.read.options(**_CSV).csv(path)
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    col = lambda c: F.trim(F.col(f"`{names[c]}`")) if c in names else F.lit(None).cast("string")
    rows = raw.select(*(F.when(col(c) != "", col(c)).alias(c) for c in GOLD_COLUMNS)).dropna("all")
    rows = rows.withColumn("expected_values", F.filter(F.transform(F.split(F.coalesce("expected_values", F.lit("")), r"\|"), lambda v: F.trim(v)), lambda v: v != ""))
    rows = rows.withColumn("answerable", ~F.coalesce(fold(F.col("answerable")).isin(UNANSWERABLE), F.lit(False)))
    bad = rows.filter("id is null or question is null").limit(1).count()
    twice = rows.groupBy("id").count().filter("count > 1").limit(5)
    if bad or (names := [r["id"] for r in twice.collect()]):
        raise ValueError("a question lacks id or question" if bad else f"ids occur twice: {names}")
    return rows


def write_gold_csv(df: DataFrame, path: str) -> None:
    """The gold columns in file order; fields are quoted only where they must be."""
    values = F.array_join("expected_values", "|") if isinstance(df.schema["expected_values"].dataType, T.ArrayType) else F.col("expected_values")
    flag = F.when(F.col("answerable"), "sim").otherwise("nao") if isinstance(df.schema["answerable"].dataType, T.BooleanType) else F.col("answerable")
    df.withColumn("expected_values", values).withColumn("answerable", flag).select(*GOLD_COLUMNS).write.options(header=True, escape='"', emptyValue="").csv(path)


def append_cases(cases: DataFrame, path: str) -> None:
    """Adds scored cases to a run store, one folder a run."""
    cases.write.mode("append").partitionBy("run_id").json(path)


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored cases; rows of an older shape, which lack an arm, are left out. A run left running counts as broken."""
    df = spark.read.schema(schema).json(path)
    return df.filter("arm is not null").withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status")))


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_run(cases: DataFrame, path: str) -> None:
    """Writes whole runs in place of what is stored of them; other runs stay."""
    cases.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def delete_run(spark: SparkSession, path: str, run_id: str) -> None:
    fs, p = _folder(spark, f"{path}/run_id={run_id}")
    fs.delete(p, True)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, layout, parse_hash``: frozen layouts, a JSON file a document, with the hash of their content."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("name"))
    return files.select(F.regexp_replace("name", r"\.json$", "").alias("document_id"), F.col("value").alias("layout"), F.sha2("value", 256).alias("parse_hash"))


def save_artefacts(spark: SparkSession, blocks: DataFrame, path: str) -> None:
    """Parsed blocks and their sections as tables, in place of what was there."""
    blocks.write.mode("overwrite").parquet(f"{path}/parsed")
    stored = spark.read.schema(blocks.schema).parquet(f"{path}/parsed")
    stored.filter("kind = 'section'").select("document_id", "block_index", "level", "item_number", "text").write.mode("overwrite").parquet(f"{path}/sections")


def save_retrievals(candidates: DataFrame, path: str) -> None:
    """Adds what was retrieved for each question: its candidates by score as one array."""
    one = F.struct((-F.col("rrf")).alias("order"), "rowid", "rrf", "selected")
    candidates.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("candidates")).write.mode("append").parquet(path)


def lab_report(results: DataFrame) -> tuple[str, str]:
    """A report of configurations as markdown and JSON, by hit and then by latency; a row is a configuration of the grid."""
    rows = [r.asDict() for r in results.orderBy(F.desc("hit"), "latency_ms", "name").collect()]
    lines = ["| name | questions | hit | ms |", "| --- | --- | --- | --- |", *(f"| {r['name']} | {r['questions']} | {r['hit']:.3f} | {r['latency_ms']:.0f} |" for r in rows)]
    return "\n".join(lines), json.dumps({"results": rows}, ensure_ascii=False)


def new_uploads(spark: SparkSession, path: str, known: DataFrame, most: int = 100 << 20) -> DataFrame:
    """PDF files of a folder that are new by content: path, size and sha256. Larger files and others are left out.

    ``known`` has sha256 of what the workspace holds.
    """
    files = spark.read.format("binaryFile").load(path).filter((F.col("length") <= most) & (F.substring(F.col("content"), 1, 5).cast("string") == "%PDF-"))
    hashed = files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return hashed.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")


def vector_from_blob(blob) -> Column:
    """Little-endian float32 bytes as an array, four bytes a number; null stays null."""
    blob = F.col(blob) if isinstance(blob, str) else blob
    return _from_blob(blob)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _from_blob(blob: pa.Array) -> pa.Array:
    sizes = np.array([len(b) // 4 if b is not None else 0 for b in blob.to_pylist()])
    raw = b"".join(b[: len(b) // 4 * 4] for b in blob.to_pylist() if b is not None)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([not v for v in blob.is_valid().to_pylist()] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(raw, dtype="<f4")))


@F.arrow_udf(T.BinaryType())
def _to_blob(vector: pa.Array) -> pa.Array:
    flat = np.asarray(vector.flatten().to_numpy(zero_copy_only=False), dtype="<f4").tobytes()
    ends = np.cumsum([0 if v is None else 4 * len(v) for v in vector.to_pylist()])
    valid = vector.is_valid().to_pylist()
    return pa.array([flat[a:z] if ok else None for a, z, ok in zip([0, *ends[:-1]], ends, valid)], type=pa.binary())


def vector_to_blob(vector) -> Column:
    return _to_blob(F.col(vector) if isinstance(vector, str) else vector)
