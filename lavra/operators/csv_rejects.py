"""Problem 2: records that fail to parse, separated from those that load.

Records are grouped by the layout of their file (separator and columns). Within
an Arrow batch each layout is parsed once by the CSV reader of pyarrow, whose
invalid-row callback reports the records with a wrong number of fields; all
fields are read as strings and cast as vectors afterwards.
"""

from __future__ import annotations

import io
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table

#: The accepted spellings of answerable.
TRUE_WORDS = ["sim", "s", "yes", "true", "1"]
FALSE_WORDS = ["não", "nao", "no", "n", "false", "0"]
COLUMNS = ["id", "workspace", "topic", "nivel", "question", "expected_item", "expected_document", "expected_values", "expected_answer", "answerable"]
SEPARATORS = {"tab": "\t", "semicolon": ";", "comma": ","}
#: Visible content: everything but blanks, control and format characters at either end.
_EDGE = r"[\s   -​    　﻿]"
_BLANK = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_SCHEMA = "line_id bigint, file_name string, line_no int, " + ", ".join(f"{c} string" for c in COLUMNS) + ", answer_flag boolean, reason string"


def strip_edges(c: Column) -> Column:
    """Without blanks, line ends and byte order marks at both ends."""
    return F.regexp_replace(c, f"^{_EDGE}+|{_EDGE}+$", "")


@lru_cache
def quoting_rule(sep: str) -> re.Pattern:
    """Matches records whose fields are quoted whole, with doubled quotes inside, or hold no quote."""
    blank = r"[^\S\t]*" if sep == "\t" else r"\s*"
    s = re.escape(sep)
    field = rf'(?:{blank}"(?:[^"]|"")*"{blank}|[^"{s}]*)'
    return re.compile(rf"{field}(?:{s}{field})*\Z")


def _quoted(text: str, sep: str) -> str:
    """The record as one line for the reader: no blanks around quoted fields, no bare line breaks."""
    if '"' not in text:
        return text.replace("\r", " ").replace("\n", " ")
    parts = re.split(r'("(?:[^"]|"")*")', text)
    blank = _BLANK.replace(sep, "")
    for k in range(0, len(parts), 2):  # outside of quotes
        part = parts[k].replace("\r", " ").replace("\n", " ")
        part = part.lstrip(blank) if k else part
        parts[k] = part.rstrip(blank) if k < len(parts) - 1 else part
    return "".join(parts)


def _parse(ids: list[int], records: list[str], sep: str, columns: list[str]) -> tuple[pa.Table, list[int]]:
    """The table of the records with the right number of fields, and the ids of the others."""
    wrong: list[int] = []

    def on_invalid(row) -> str:
        wrong.append(int(row.text.split(sep, 1)[0].strip('"')))
        return "skip"

    body = "\n".join(f"{i}{sep}{_quoted(r, sep)}" for i, r in zip(ids, records))
    names = ["__line_id", *(f"{k}:{c}" for k, c in enumerate(columns))]
    parsed = pcsv.read_csv(
        io.BytesIO(body.encode("utf-8", "replace")),
        read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, 4 * len(body) + 64)),
        parse_options=pcsv.ParseOptions(delimiter=sep, newlines_in_values=True, invalid_row_handler=on_invalid),
        convert_options=pcsv.ConvertOptions(column_types={n: pa.int64() if n == "__line_id" else pa.string() for n in names}, strings_can_be_null=False),
    )
    return parsed, wrong


def parse_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Columns line_id, file_name, line_no, raw_line, header -> the fields and reason (id repeats not yet judged)."""
    rows = batch.to_pydict()
    groups: dict[str | None, list[int]] = {}
    for k, header in enumerate(rows["header"]):
        groups.setdefault(header, []).append(k)
    line_no = {}
    out: dict[int, dict] = {}
    for k, lid in enumerate(rows["line_id"]):
        line_no[k] = lid
        out[k] = dict.fromkeys(COLUMNS) | {"answer_flag": None, "reason": None}
    for header, members in groups.items():
        head = (header or "").strip(_BLANK).lower()
        sep = max(SEPARATORS.values(), key=head.count)
        columns = [c.strip(_BLANK + '"') for c in head.split(sep)]
        rule, fit = quoting_rule(sep), []
        for k in members:
            record = rows["raw_line"][k].removeprefix("﻿").removesuffix("\r")
            if rule.match(record):
                fit.append((k, record))
            else:
                out[k]["reason"] = "quoting"
        if not fit:
            continue
        parsed, wrong = _parse([k for k, _ in fit], [r for _, r in fit], sep, columns)
        for k in wrong:
            out[k]["reason"] = "columns"
        where = parsed.column(0).to_pylist()
        fields = {}
        for n, c in enumerate(columns):
            if c in COLUMNS and c not in fields:
                fields[c] = pc.utf8_trim(parsed.column(n + 1), characters=_BLANK)
        # casts over whole vectors; a missing column fails its check
        empty = pa.chunked_array([pa.array([""] * len(where))])
        flag = pc.utf8_lower(fields.get("answerable", empty))
        yes, no = pc.is_in(flag, pa.array(TRUE_WORDS)), pc.is_in(flag, pa.array(FALSE_WORDS))
        checks = [("id", pc.equal(fields.get("id", empty), "")), ("question", pc.equal(fields.get("question", empty), "")), ("answerable", pc.invert(pc.or_(yes, no)))]
        reason = pc.case_when(pc.make_struct(*(c for _, c in checks)), *(pa.scalar(n) for n, _ in checks)).to_pylist() if where else []
        values = {c: v.to_pylist() for c, v in fields.items()}
        truth = yes.to_pylist()
        for n, k in enumerate(where):
            out[k]["reason"] = reason[n]
            for c, v in values.items():
                out[k][c] = v[n]
            out[k]["answer_flag"] = None if reason[n] == "answerable" else truth[n]
    n = range(len(rows["line_id"]))
    cols = [batch.column("line_id"), batch.column("file_name"), batch.column("line_no")]
    cols += [pa.array([out[k][c] for k in n], type=pa.string()) for c in COLUMNS]
    cols += [pa.array([out[k]["answer_flag"] for k in n], type=pa.bool_()), pa.array([out[k]["reason"] for k in n], type=pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["line_id", "file_name", "line_no", *COLUMNS, "answer_flag", "reason"])


def load_records(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Every record of ``raw`` with its fields and the first reason that refuses it (null: it loads).

    ``raw`` has line_id (unique), file_name, line_no and raw_line; line 1 of a
    file is its header. Headers, blank lines and null lines are no records. A
    record of a file without a header has one column of an unknown name, so it
    fails by ``columns`` or ``id``. Reasons, in order: quoting, columns, id,
    question, answerable. An id is repeated if an earlier record of the file
    with readable fields has it. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = raw.select("line_id", "file_name", "line_no", "raw_line").distinct().filter(F.col("raw_line").isNotNull() & (strip_edges("raw_line") != ""))
    headers = rows.filter("line_no = 1").select(F.col("file_name").alias("__f"), F.col("raw_line").alias("header"))
    # a header is kept once for each file; a file may hold a third of all rows, which AQE splits
    records = rows.filter("line_no <> 1 or line_no is null").join(headers, F.col("file_name").eqNullSafe(F.col("__f")), "left").drop("__f")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield parse_batch(b)

    parsed = materialize(spark, records.mapInArrow(run, _SCHEMA), "records")
    # first record of each id: aggregated before the shuffle, so a hot id is no hot task
    has_id = parsed.filter("id <> ''")
    firsts = has_id.groupBy("file_name", "id").agg(F.min(F.struct("line_no", "line_id")).alias("m")).select(F.col("m.line_id").alias("line_id"), F.lit(True).alias("first"))
    again = F.col("id").isNotNull() & (F.col("id") != "") & F.col("first").isNull()
    before_id = F.col("reason").isin("quoting", "columns")
    return parsed.join(firsts, "line_id", "left").withColumn("reason", F.when(before_id, F.col("reason")).when(again, F.lit("id")).otherwise(F.col("reason"))).drop("first")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_records(spark, table(spark, sf_dir, "nucleo_raw")).filter("reason is not null").select("line_id", "reason").distinct()


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that load, as typed gold questions."""
    good = load_records(spark, table(spark, sf_dir, "nucleo_raw")).filter("reason is null")
    none = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return good.select("line_id", "file_name", *(none(c) for c in COLUMNS[:-1]), F.col("answer_flag").alias("answerable"))


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded}
ORACLE: dict[str, str] = {}
