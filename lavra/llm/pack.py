"""Problem 9: filling containers of fixed capacity.

A text of more than the capacity is cut into full pieces and one rest; a full
piece has a container for itself. Everything else is planned over the histogram
of lengths, which has at most ``capacity`` entries however many texts there
are: best fit, the longest lengths first. All items of a length are placed at once: the
open container with the least room that still takes one is filled with as many as
it takes, and all containers of the same room with it. The plan is a list of runs
(length, first rank, last rank, first container, items of that length in each
container). Texts take their slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, table
from .bpe import vocabulary
from .encode import count_tokens

CAPACITY = 2048
#: Items that are ranked in one group; a length with more of them is ranked in several.
CELL = 20_000


def plan_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, rank_from, rank_to, container_from, per_container) and the number of containers.

    Lengths of 0 are not planned. Ranks count from 0; ``rank_to`` is exclusive.
    Every item goes where best fit puts it that takes the items one by one, the longest first.
    """
    rooms: list[int] = []  # rooms of open containers, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first container, containers) with it

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    runs, containers = [], 0
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, rank = counts[length], 0
        while left > 0:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first = capacity, containers
                n = -(-left // (capacity // length))
                containers += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, rank + whole * each, first, each))
                put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            rest = n - whole
            if rest and left and left < each:  # the last items do not fill the next container
                runs.append((length, rank, rank + left, first + whole, left))
                put(room - left * length, first + whole, 1)
                rank, left, whole, rest = rank + left, 0, whole + 1, rest - 1
            put(room, first + whole, rest)
    return runs, containers


def pack(spark: SparkSession, sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """``key, piece, tokens, container`` for each piece of each item of ``sizes``.

    ``sizes`` holds an item a row; ``key`` is unique. Null, zero and negative
    sizes count as 0: such items take no room and are spread over the containers.
    An empty table gives an empty table. Ranks within a length are counted in
    two steps (a count for each length and salt, then a rank within the salt); a
    length has as many salts as its count needs, so none is ranked in one task.
    """
    kind = sizes.schema[key].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    cap = F.lit(capacity)
    rest = sizes.select(F.col(key), n.alias("n")).select(key, (F.col("n") / cap).cast("long").alias("full"), (F.col("n") % cap).alias("length"))
    # at most ``capacity`` rows, whatever the number of items
    lengths = {r["length"]: r["c"] for r in rest.groupBy("length").agg(F.count("*").alias("c")).collect()}
    runs, planned = plan_histogram({k: v for k, v in lengths.items() if k > 0}, capacity)
    spread = max(1, planned)
    salts = spark.createDataFrame([(int(k), int(-(-v // cell))) for k, v in lengths.items()], "length bigint, salts bigint")
    rest = rest.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(F.col(key).cast("string")), "salts")).drop("salts")
    # a row for each ``cell`` items: where the ranks and the full pieces of each begin
    cells = rest.groupBy("length", "salt").agg(F.count("*").alias("c"), F.sum("full").alias("fulls"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    by_length = cells.groupBy("length").agg(F.sum("fulls").alias("all_fulls"))
    first_full = by_length.withColumn("own", F.coalesce(F.sum("all_fulls").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all_fulls")
    bases = cells.join(F.broadcast(first_full), "length").select(
        "length", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("rank0"), (F.lit(planned) + F.col("own") + F.coalesce(F.sum("fulls").over(before), F.lit(0))).alias("full0"))
    w = Window.partitionBy("length", "salt").orderBy(key)
    ranked = rest.withColumn("r", F.row_number().over(w) - 1).withColumn("f", F.coalesce(F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(bases, ["length", "salt"]).select(key, "length", "full", (F.col("rank0") + F.col("r")).alias("rank"), (F.col("full0") + F.col("f")).alias("full0"))
    runs.sort()
    starts = np.array([r[0] for r in runs], dtype=np.int64), np.array([r[1] for r in runs], dtype=np.int64)
    plan = spark.sparkContext.broadcast((*starts, np.array([r[3] for r in runs], dtype=np.int64), np.array([r[4] for r in runs], dtype=np.int64)))

    def place(batches):
        of_length, start, first, take = plan.value
        for b in batches:
            length, full, rank, full0 = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "full", "rank", "full0"))
            container = rank % spread
            for x in np.unique(length[length > 0]):
                here = np.flatnonzero(length == x)
                a, z = np.searchsorted(of_length, x), np.searchsorted(of_length, x, side="right")
                run = a + np.searchsorted(start[a:z], rank[here], side="right") - 1
                container[here] = first[run] + (rank[here] - start[run]) // take[run]
            # full pieces first, then the rest, if there is one or nothing else
            times = full + ((length > 0) | (full == 0))
            at = np.repeat(np.arange(len(times)), times)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            is_full = piece < full[at]
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(at)), pa.array(piece), pa.array(np.where(is_full, capacity, length[at])), pa.array(np.where(is_full, full0[at] + piece, container[at]))],
                names=[key, "piece", "tokens", "container"],
            )

    return placed.mapInArrow(place, f"`{key}` {kind}, piece bigint, tokens bigint, container bigint")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, capacity 2,048 tokens of byte_bpe_50k."""
    sizes = materialize(spark, count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary()), "sizes")
    return pack(spark, sizes, "doc_id", "n_tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of used space against the bound of ceil(tokens / capacity)."""
    per = p9_containers(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"),
        F.ceil(F.sum("t") / F.lit(CAPACITY)).alias("least"), F.round(F.sum("t") / (F.count("*") * CAPACITY), 6).alias("used"),
    )


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLE: dict[str, str] = {}
