"""Problem 6: oversized texts cut into pieces under a limit, at natural boundaries, with overlap.

The least number of pieces gives equal-length targets; each target is moved to
the strongest boundary near it (paragraph, line, sentence, blank, then any
place). If a piece breaks the limit, one piece is added and the targets are
placed anew; where boundaries are so uneven that no such division is found, pieces
are cut one after another at the strongest boundary within the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .encode import slices
from .sentences import Model, fit, sentences

LIMIT, OVERLAP = 1600, 150
#: Share of a target's length that it may move by.
REACH = 0.35
#: Fixed order of boundaries, the strongest first, with their weight against the distance.
STRENGTH = {"paragraph": 4.0, "line": 3.0, "sentence": 2.0, "blank": 1.0}

_PARAGRAPH = re.compile(r"\s*\n\s*\n\s*")
_LINES = re.compile(r"[\n\r\v\f\x85  ]")
_BLANK = re.compile(r"\s+")


def boundaries(text: str, spans: list[tuple[int, int]]) -> tuple[list[int], list[float]]:
    """Places where a new piece may begin, in order, with their strength."""
    found: dict[int, float] = {}
    for m in _BLANK.finditer(text):
        found[m.end()] = STRENGTH["line"] if _LINES.search(m.group()) else STRENGTH["blank"]
    for s, _ in spans[1:]:
        found[s] = max(found.get(s, 0.0), STRENGTH["sentence"])
    for m in _PARAGRAPH.finditer(text):
        found[m.end()] = STRENGTH["paragraph"]
    found.pop(0, None)
    found.pop(len(text), None)
    places = sorted(found)
    return places, [found[p] for p in places]


def overlap_start(places: list[int], strong: list[float], cut: int, overlap: int, floor: int) -> int:
    """Where the piece behind ``cut`` begins: at the strongest boundary within the overlap before it, the farthest if equal."""
    low = max(floor + 1, cut - overlap)
    a, b = bisect_left(places, low), bisect_left(places, cut)
    if a == b:
        return min(low, cut)
    best = max(range(a, b), key=lambda k: (min(strong[k], STRENGTH["sentence"]), -places[k]))
    return places[best]


def cut_text(text: str, spans: list[tuple[int, int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces (start, end) that cover the text; each is at most ``limit`` long and begins up to ``overlap`` before the end of the last.

    A text within the limit is one piece, an empty one none.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    overlap = min(overlap, limit // 2)
    places, strong = boundaries(text, spans)
    count = 1 + -(-(n - limit) // (limit - overlap))
    most = 4 * count + 8
    while count <= most:
        size = n / count
        reach = REACH * size
        pieces, start, cut = [], 0, 0
        for j in range(1, count):
            target = n * j / count
            low, high = max(cut + 1, target - reach), min(start + limit, target + reach)
            a, b = bisect_left(places, low), bisect_right(places, high)
            if high < low:
                break
            new = int(min(target, start + limit))
            if a < b:
                new = places[max(range(a, b), key=lambda k: strong[k] - abs(places[k] - target) / size)]
            if new <= cut:
                break
            pieces.append((start, new))
            start, cut = overlap_start(places, strong, new, overlap, start), new
        else:
            if n - start <= limit:
                return [*pieces, (start, n)]
        count += 1
    return cut_in_turn(n, places, strong, limit, overlap)


def cut_in_turn(n: int, places: list[int], strong: list[float], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces one after another where no balanced division was found: each ends at the strongest boundary within the limit, the farthest if equal.

    Only where there is no boundary is a text cut at the limit.
    """
    pieces, start, cut = [], 0, 0
    while n - start > limit:
        a, b = bisect_right(places, max(cut, start + overlap)), bisect_right(places, start + limit)
        new = places[max(range(a, b), key=lambda k: (strong[k], places[k]))] if a < b else start + limit
        pieces.append((start, new))
        start, cut = overlap_start(places, strong, new, overlap, start), new
    return [*pieces, (start, n)]


def split_oversized(spark: SparkSession, df: DataFrame, key: str, text: str, model: Model, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key, kind, piece, piece_start, piece_end`` for each piece of each distinct text above the limit.

    ``kind`` is ``natural`` if every sentence is within the limit, else
    ``forced``: some piece is then cut within a sentence. Null and shorter
    texts have no rows.
    """
    rows = df.filter(F.length(text) > limit).select(key, text).distinct()
    shared = spark.sparkContext.broadcast(model)
    kind_ = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                kinds, found = [], []
                for t in texts:
                    spans = sentences(t, shared.value)
                    kinds.append("natural" if all(e - s <= limit for s, e in spans) else "forced")
                    found.append(cut_text(t, spans, limit, overlap))
                n = [len(f) for f in found]
                rows_ = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)).take(rows_), pa.array(kinds, type=pa.string()).take(rows_), pa.array([i for k in n for i in range(k)], type=pa.int32()),
                     pa.array([s for f in found for s, _ in f], type=pa.int32()), pa.array([e for f in found for _, e in f], type=pa.int32())],
                    names=[key, "kind", "piece", "piece_start", "piece_end"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind_}, kind string, piece int, piece_start int, piece_end int")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("rowid", "text")
    return split_oversized(spark, chunks, "rowid", "text", fit(spark, chunks, "text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).select("rowid", "kind").distinct()


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
ORACLE: dict[str, str] = {}
