"""Problem 4: conversations rebuilt from message rows by keyed streaming state.

Messages stream in by arrival time, in micro-batches. State is kept for a segment:
the messages of one conversation created on one day. A segment buffers late and
repeated deliveries and is emitted in order, with its own verdict on the steps between
roles, once the watermark has passed its last message by the allowed lateness; what
is still open when the stream ends is closed from the state itself. Segments are small
and their verdicts merge, so a conversation of any length is never state of one key.
The merge offsets positions by the earlier segments and checks the steps from segment
to segment. Segments share keys of state by hash (a slot holds many), so that what a
key costs is paid for many segments at once; a slot's timeout is that of its first segment.

A stored table is replayed in the order of arrival: its rows are laid down in files by
ranges of received_at, and the files are read a few at a time. No row is later than the
watermark then. A stream that brings rows later than the watermark is an error, with
their number: a result without them would not be whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..session import shared_dir, table

#: The roles in the order in which a conversation may hold them.
ROLES = {"system": 0, "user": 1, "assistant": 2}
BROKEN = 3
LATENESS = "30 days"
LATENESS_MS = 30 * 86_400_000
#: Steps between roles that a kept conversation may have.
STEPS = {(0, 0), (0, 1), (1, 2), (2, 1)}

_BLANK = r"[\s\u001C-\u001F\u0085   -‏ -  -⁤　﻿­]"
_OUT = "conversation_id string, message_id string, created_at timestamp, code int, local int, steps_ok boolean, day bigint"
_STATE = "conversations array<string>, days array<bigint>, ids array<string>, created array<bigint>, received array<bigint>, codes array<int>"
#: Slots of state for each shuffle partition.
SLOTS = 16
_MESSAGE = "id string, conversation_id string, role string, content string, created_at timestamp, received_at timestamp"


#: Rows of a file of the replay, least files, and most micro-batches.
FILE_ROWS, LEAST_FILES, MOST_BATCHES = 250_000, 4, 64


def in_order(messages: dict[tuple[str, int], dict[str, tuple]]) -> pd.DataFrame:
    """The messages of segments in order, each with its segment's verdict; a message is (received, created, code)."""
    rows = []
    for (conversation, day), own in messages.items():
        order = sorted(own.items(), key=lambda m: (m[1][1], m[0]))
        roles = [m[1][2] for m in order]
        fine = BROKEN not in roles and all(s in STEPS for s in zip(roles, roles[1:]))
        rows += [(conversation, i, created, code, k, fine, day) for k, (i, (_, created, code)) in enumerate(order)]
    out = pd.DataFrame(rows, columns=["conversation_id", "message_id", "created_at", "code", "local", "steps_ok", "day"])
    return out.astype({"code": "int32", "local": "int32", "day": "int64"}).assign(created_at=pd.to_datetime(out["created_at"], unit="us"))


def buffered(columns) -> dict[tuple[str, int], dict[str, tuple]]:
    """Messages by segment; of one id the last delivery counts."""
    out: dict[tuple[str, int], dict[str, tuple]] = {}
    for conversation, day, i, created, received, code in zip(*columns):
        own = out.setdefault((conversation, int(day)), {})
        new = (int(received), int(created), int(code))
        if i not in own or new > own[i]:
            own[i] = new
    return out


def deadline(own: dict[str, tuple]) -> int:
    """When a segment closes, in milliseconds: the lateness behind its last message and delivery."""
    return max(max(r, c) for r, c, _ in own.values()) // 1000 + LATENESS_MS


def slot(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Buffers the messages of the segments of a slot; emits in order those whose time has passed."""
    columns: list[list] = [list(c) for c in state.get] if state.exists else [[] for _ in range(6)]
    for f in frames if not state.hasTimedOut else ():
        for c, name in zip(columns, ("conversation_id", "day", "id", "created_us", "received_us", "code")):
            c += f[name].tolist()
    messages, now = buffered(columns), state.getCurrentWatermarkMs()
    ends = {k: deadline(own) for k, own in messages.items()}
    done = {k: own for k, own in messages.items() if ends[k] <= now}
    rest = [(c, d, i, t, r, k) for (c, d), own in messages.items() if ends[c, d] > now for i, (r, t, k) in own.items()]
    if rest:
        state.update(tuple(list(c) for c in zip(*rest)))
        state.setTimeoutTimestamp(max(min(e for e in ends.values() if e > now), now + 1))
    else:
        state.remove()
    if done:
        yield in_order(done)


def prepared(messages: DataFrame) -> DataFrame:
    """What the state needs of each row: ids, times in microseconds and a code for role and content."""
    role = F.lower(F.regexp_replace("role", f"^{_BLANK}+|{_BLANK}+$", ""))
    code = F.lit(BROKEN)
    for name, number in ROLES.items():
        code = F.when(role == name, number).otherwise(code)
    visible = F.regexp_replace("content", _BLANK, "") != ""
    return messages.select(
        F.coalesce("id", F.lit("")).alias("id"), "conversation_id",
        F.coalesce(F.unix_micros("created_at"), F.lit(-1)).alias("created_us"), F.coalesce(F.unix_micros("received_at"), F.lit(0)).alias("received_us"),
        F.when(visible & F.col("created_at").isNotNull() & F.col("role").isNotNull() & F.col("id").isNotNull(), code).otherwise(BROKEN).cast("int").alias("code"),
        F.coalesce(F.floor(F.unix_micros("created_at") / F.lit(86_400_000_000)), F.lit(-1)).cast("long").alias("day"),
        F.coalesce("received_at", F.timestamp_seconds(F.lit(0))).alias("event_time"),
    )


class LateRows(RuntimeError):
    """Rows came later than the watermark; ``number`` of them."""

    def __init__(self, number: int):
        super().__init__(f"{number} rows came later than the watermark of {LATENESS}")
        self.number = number


def replay(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """A stored table as a stream in the order of arrival, in several micro-batches."""
    rows = messages.select("id", "conversation_id", "role", "content", "created_at", "received_at")
    files = max(LEAST_FILES, -(-rows.count() // FILE_ROWS))
    folder = shared_dir(spark, "arrivals")
    rows.repartitionByRange(files, F.col("received_at").asc_nulls_first()).sortWithinPartitions("received_at").write.parquet(folder)
    # the file source takes the oldest files first: the files' times follow the ranges
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")))
    for i, name in enumerate(parts):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), 1_000_000_000_000 + 60_000 * i, -1)
    return spark.readStream.schema(_MESSAGE).option("maxFilesPerTrigger", max(1, -(-len(parts) // MOST_BATCHES))).option("maxFileAge", "36500d").parquet(folder)


def _open_segments(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The segments that the end of the stream left in the state, in order."""

    def run(frames):
        for f in frames:
            for columns in zip(f["conversations"], f["days"], f["ids"], f["created"], f["received"], f["codes"]):
                yield in_order(buffered(columns))

    left = spark.read.format("statestore").load(checkpoint)
    state = left.select("value.groupState.*").select("conversations", "days", "ids", "created", "received", "codes")
    return state.mapInPandas(run, _OUT)


def segments(spark: SparkSession, stream: DataFrame, known: DataFrame) -> DataFrame:
    """Emitted segments of all messages whose conversation is known.

    The stream is read to its end in the micro-batches its source makes. Segments
    past the watermark are emitted as it moves on; those still open at the end are
    taken from the state. Rows later than the watermark raise ``LateRows``.
    """
    slots = SLOTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = known.select(F.col("id").alias("conversation_id")).filter("conversation_id is not null").distinct()
    rows = prepared(stream.select("id", "conversation_id", "role", "content", "created_at", "received_at")).join(ids, "conversation_id", "left_semi")
    state = (
        rows.withColumn("slot", F.pmod(F.xxhash64("conversation_id", "day"), F.lit(slots))).withWatermark("event_time", LATENESS).groupBy("slot")
        .applyInPandasWithState(slot, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    out, checkpoint = shared_dir(spark, "segments"), shared_dir(spark, "state")
    query = state.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(out)
    query.awaitTermination()
    progress = query.recentProgress
    late = sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"])
    if late:
        raise LateRows(late)
    emitted = spark.read.schema(_OUT).parquet(out)
    return emitted.unionByName(_open_segments(spark, checkpoint)) if progress and any(p["stateOperators"] for p in progress) else emitted


def merge(rows: DataFrame) -> DataFrame:
    """``conversation_id, pos, message_id`` of the conversations that are whole, from their segments' rows."""
    rows = rows.filter("conversation_id is not null")
    ends = rows.groupBy("conversation_id", "day").agg(
        F.count("*").alias("n"), F.min_by("code", "local").alias("first"), F.max_by("code", "local").alias("last"), F.bool_and("steps_ok").alias("fine"))
    w = Window.partitionBy("conversation_id").orderBy("day")
    before, step = F.lag("last").over(w), F.col("first")
    legal = F.when(before.isNull(), step.isin(0, 1)).otherwise(((before == 0) & step.isin(0, 1)) | ((before == 1) & (step == 2)) | ((before == 2) & (step == 1)))
    placed = ends.select("conversation_id", "day", "last", (F.col("fine") & legal).alias("fine"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    whole = placed.groupBy("conversation_id").agg(F.bool_and("fine").alias("fine"), F.max_by("last", "day").alias("end")).filter("fine and end = 2").select("conversation_id")
    kept = placed.join(whole, "conversation_id").select("conversation_id", "day", "offset")
    return rows.join(kept, ["conversation_id", "day"]).select("conversation_id", (F.col("offset") + F.col("local") + 1).cast("int").alias("pos"), "message_id")


def rebuild(spark: SparkSession, stream: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conversation_id, pos, message_id`` of every kept conversation.

    Rows with one id are one message, of which the last delivery counts; a
    redelivery keeps its created_at. A conversation is left out if it is
    unknown, if a message lacks id, created_at, visible content or one of the
    roles user, assistant, system (case and blanks apart), or if the roles are
    not system messages first and then user and assistant in turns up to an
    answer. Rows without conversation_id belong nowhere. Ties in created_at are
    ordered by id. Empty tables give no rows; other columns are not read.
    """
    return merge(segments(spark, stream, conversations))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild(spark, replay(spark, table(spark, sf_dir, "messages")), table(spark, sf_dir, "conversations"))


def p4_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept conversations by number of messages."""
    return p4_found(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("messages")).groupBy("messages").agg(F.count("*").alias("conversations"))


QUERIES = {"p4_found": p4_found, "p4_lengths": p4_lengths}
_LINE = "regexp_replace({}, '[\\s\\x1C-\\x1F\\x85\\xA0\\x{{1680}}\\x{{2000}}-\\x{{200F}}\\x{{2028}}-\\x{{202F}}\\x{{205F}}-\\x{{2064}}\\x{{3000}}\\x{{FEFF}}\\xAD]', '', 'g')"
_KEPT = f"""
with m as (
  select id, any_value(conversation_id) c, arg_max(created_at, received_at) t, lower({_LINE.format("arg_max(role, received_at)")}) r,
         {_LINE.format("arg_max(content, received_at)")} x
  from messages where conversation_id in (select id from conversations) group by id),
p as (select *, row_number() over (partition by c order by t, id) pos, lag(r) over (partition by c order by t, id) b,
         lead(r) over (partition by c order by t, id) a from m),
k as (select c from p group by c having bool_and(
    t is not null and coalesce(x, '') <> '' and case coalesce(b, '')
      when '' then r in ('system', 'user') when 'system' then r in ('system', 'user') when 'user' then r = 'assistant'
      when 'assistant' then r = 'user' else false end and (a is not null or r = 'assistant')) is true)
"""
ORACLE = {
    "p4_found": _KEPT + "select c as conversation_id, cast(pos as integer) as pos, id as message_id from p where c in (select c from k)",
    "p4_lengths": _KEPT + "select n as messages, count(*) as conversations from (select c, count(*) n from p where c in (select c from k) group by c) group by n",
}
