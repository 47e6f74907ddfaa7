"""Problem 3: several values packed in one field.

A field becomes a lattice. Its nodes are all places where a delimiter may
divide, its edges the values between any two of them; quoted spans are atomic.
Expectation-maximisation over the whole column learns two things until it
converges: how frequent values of each shape are, and how often a delimiter
divides in each context (what stands on either side of it). Forward-backward over
every lattice gives the expected counts, which are summed by bucket before they
leave the executors. The most likely path through the lattice is the division.

A value that a comma bounds is quoted, a plain amount, date or percentage, or
one that is known to the column as a whole value: free text cannot be spelled out
between two commas, as commas belong to text.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, spread, table

#: Buckets of value shapes in each of two hash rows; a shape's count is the lesser of its two.
BUCKETS = 1 << 20
#: Most rounds of the training, and the change of the likelihood (a share) at which it ends.
ROUNDS, CONVERGED = 12, 1e-4
#: Nats to spell a value that was never seen: once, and for each character.
UNSEEN, PER_CHAR = 1.0, 2.0
#: Taken off every expected count: what was seen once, and so perhaps only in the field asked about, is no known value.
DISCOUNT = 1.0
#: Share of divisions expected in a context before training, and how many cases that weighs.
PRIOR_DIVIDES, PRIOR_REST, PRIOR_WEIGHT = 0.9, 0.1, 4.0
#: Longest shape whose hash is kept in memory between rows; longer ones are hashed anew.
CACHED = 1 << 16

_QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’", "„": "“"}
_QUOTED = re.compile(r'"(?:[^"]|"")*"|“[^”]*”|«[^»]*»|\'(?:[^\']|\'\')*\'|‘[^’]*’|„[^“]*“')
_AFTER_QUOTE = re.compile(r"\s*(?:[|;,\t\n\r\]•▪◦‣●]|/(?=\s)|\Z)")
#: Always a division: bars, semicolons, line ends, slashes between blanks. Maybe one: commas, bullets where a value may begin, tabs.
_CUT = re.compile(r"[|;\n\r\v\f\x85  ]|(?<=\s)/(?=\s)|,|\t|(?:(?<=\s)|(?<![\s\S]))[•▪◦‣●]")
_SOFT = ",\t•▪◦‣●"
_NUMBER = r"[+-]?\d+(?:[.\s]\d{3})*(?:,\d+)?"
_PLAIN = re.compile(
    rf"(?:(?:R\$|US\$|\$|€|£)\s*{_NUMBER}(?:\s*(?:mil|milhão|milhões|bilhão|bilhões))?|{_NUMBER}(?:\s*%)?|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}})\Z",
    re.IGNORECASE,
)
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


@lru_cache(CACHED)
def shape_hash(value: str) -> int:
    """Hash of a value's shape: blanks collapsed, digits masked, case ignored."""
    return crc32(_SPACE.sub(" ", _DIGITS.sub("0", value)).lower().encode("utf-8", "replace"))


def buckets(value: str) -> tuple[int, int]:
    h = shape_hash(value)
    return h % BUCKETS, (h * 0x9E3779B1 & 0xFFFFFFFF) >> 12


def quoted(value: str) -> bool:
    m = _QUOTED.match(value)
    return bool(m) and m.end() == len(value)


def unwrap(value: str) -> str:
    """A value without blanks and enclosing quotes; doubled quotes become single."""
    value = value.strip()
    if quoted(value) and len(value) > 1:
        q, value = value[0], value[1:-1]
        if q in "\"'":
            value = value.replace(q * 2, q)
        value = value.strip()
    return value


def cuts(text: str) -> list[tuple[int, int]]:
    """Possible divisions as (start, end), outside of quotes. A quote opens only where a value begins."""
    out, at, fresh = [], 0, True
    while at < len(text):
        if fresh:
            while at < len(text) and text[at].isspace() and text[at] not in "\n\r\t":
                at += 1
            m = _QUOTED.match(text, at) if at < len(text) and text[at] in _QUOTES else None
            if m and _AFTER_QUOTE.match(text, m.end()):
                at, fresh = m.end(), False
                continue
        m = _CUT.search(text, at)
        if not m:
            break
        out.append(m.span())
        # behind a decimal comma no quote opens
        inside = m.group() == "," and 0 < m.start() and m.end() < len(text) and text[m.start() - 1].isdigit() and text[m.end()].isdigit()
        fresh, at = not inside, m.end()
    return out


def kind(value: str) -> str:
    """Blank, quoted, plain or text."""
    return " " if not value else "q" if quoted(value) else "p" if _PLAIN.match(value) else "t"


def context(sign: str, left: str, right: str, tight: bool) -> str:
    """What a doubtful delimiter stands between; ``tight`` between two digits."""
    return f"{sign}{kind(left.strip())}{kind(right.strip())}{'-' if tight else ''}"


def prior(ctx: str) -> float:
    """Share of divisions in a context before anything is learnt."""
    divides = ctx[0] != "," or ctx in (",pp", ",qq", ",qp", ",pq")
    return PRIOR_DIVIDES if divides else PRIOR_REST


class Lattice:
    """A piece between certain divisions: its minimal segments, and the contexts of the delimiters between them."""

    __slots__ = ("text", "bounds", "contexts")

    def __init__(self, text: str, start: int, end: int, soft: list[tuple[int, int]]):
        self.text = text
        self.bounds = [(start, start), *soft, (end, end)]
        part = [text[a[1] : b[0]] for a, b in zip(self.bounds, self.bounds[1:])] if soft else []
        self.contexts = [
            context(text[a], left, right, 0 < a and b < len(text) and text[a] == "," and text[a - 1].isdigit() and text[b].isdigit())
            for (a, b), left, right in zip(soft, part, part[1:])
        ]

    def value(self, i: int, j: int) -> str:
        return self.text[self.bounds[i][1] : self.bounds[j][0]]

    def bounded_by_comma(self, i: int, j: int) -> bool:
        a, b = self.bounds[i], self.bounds[j]
        return a[0] < a[1] and self.text[a[0]] == "," or b[0] < b[1] and self.text[b[0]] == ","


def lattices(text: str | None) -> list[Lattice]:
    """The lattice of each piece of the field; list brackets around the field do not belong to it."""
    text = (text or "").strip()
    if len(text) > 1 and text[0] == "[" and text[-1] == "]":
        text = text[1:-1]
    out, start, soft = [], 0, []
    for a, b in [*cuts(text), (len(text), len(text))]:
        if a < b and text[a] in _SOFT:
            soft.append((a, b))
            continue
        out.append(Lattice(text, start, a, soft))
        start, soft = b, []
    return out


class Model:
    """Expected counts of value shapes in two hash rows, and the share of divisions in each context."""

    def __init__(self, counts: np.ndarray | None = None, divides: dict[str, float] | None = None):
        self.counts = np.zeros((2, BUCKETS), dtype=np.float32) if counts is None else counts
        self.total = max(1.0, float(self.counts[0].sum()))
        self.divides = divides or {}

    def known(self, value: str) -> float:
        a, b = buckets(value)
        return max(0.0, min(float(self.counts[0, a]), float(self.counts[1, b])) - DISCOUNT) / self.total

    def cost(self, raw: str, between_commas: bool) -> float:
        """Nats of a value; infinite for text between commas that the column does not know."""
        value = unwrap(raw)
        if not value:
            return 0.0
        p = self.known(value)
        if not between_commas or kind(raw.strip()) != "t":
            p += math.exp(-min(700.0, UNSEEN + PER_CHAR * len(value)))
        return -math.log(p) if p > 0 else math.inf

    def share(self, ctx: str) -> float:
        return self.divides.get(ctx, prior(ctx))

    def edges(self, piece: Lattice) -> list[tuple[int, int, float]]:
        """(from, to, cost) of every possible value; the cost covers the delimiter before it and those within it."""
        shares = [min(1 - 1e-9, max(1e-9, self.share(c))) for c in piece.contexts]
        passed = np.concatenate([[0.0], np.cumsum([-math.log(1 - s) for s in shares])])
        n, out = len(piece.contexts) + 1, []
        for j in range(1, n + 1):
            for i in range(j - 1, -1, -1):
                c = self.cost(piece.value(i, j), piece.bounded_by_comma(i, j))
                if c < math.inf:
                    out.append((i, j, c + float(passed[j - 1] - passed[i]) + (-math.log(shares[i - 1]) if i else 0.0)))
        return out


def expected(piece: Lattice, model: Model, weight: float, values: dict[int, float], signs: dict[str, list[float]]) -> float:
    """Adds the expected number of values by shape and of divisions by context (forward-backward); the log likelihood."""
    last = len(piece.contexts) + 1
    if last == 1:
        v = unwrap(piece.value(0, 1))
        if v:
            h = shape_hash(v)
            values[h] = values.get(h, 0.0) + weight
        return 0.0
    edges = model.edges(piece)
    forward, backward = np.full(last + 1, -np.inf), np.full(last + 1, -np.inf)
    forward[0] = backward[last] = 0.0
    for i, j, c in edges:  # in order of their ends
        forward[j] = np.logaddexp(forward[j], forward[i] - c)
    for i, j, c in sorted(edges, key=lambda e: -e[0]):
        backward[i] = np.logaddexp(backward[i], backward[j] - c)
    cut = np.zeros(last + 1)
    for i, j, c in edges:
        p = math.exp(min(0.0, forward[i] - c + backward[j] - forward[last]))
        cut[j] += p
        v = unwrap(piece.value(i, j))
        if v and p > 1e-6:
            h = shape_hash(v)
            values[h] = values.get(h, 0.0) + p * weight
    for k, ctx in enumerate(piece.contexts):
        s = signs.setdefault(ctx, [0.0, 0.0])
        s[0] += float(cut[k + 1]) * weight
        s[1] += weight
    return float(forward[last]) * weight


def divide(text: str | None, model: Model) -> list[str]:
    """The values of the most likely path, blank ones left out; of equal costs the finer division wins."""
    out = []
    for piece in lattices(text):
        last = len(piece.contexts) + 1
        if last == 1:
            path = [(0, 1)]
        else:
            best, back = [math.inf] * (last + 1), [0] * (last + 1)
            best[0] = 0.0
            for i, j, c in model.edges(piece):
                if best[i] + c < best[j] - 1e-12:
                    best[j], back[j] = best[i] + c, i
            path, j = [], last
            while j:
                path.append((back[j], j))
                j = back[j]
        out += [u for i, j in reversed(path) if (u := unwrap(piece.value(i, j)))]
    return out


def learn(spark: SparkSession, df: DataFrame, text: str) -> Model:
    """The model of all rows of the column, trained until its likelihood no longer changes.

    Rows with one text are counted with their number, but once where a delimiter is
    doubtful: repeating a list makes it no likelier a value. What comes back from
    a round has at most 2 x BUCKETS rows and one for each context and partition.
    """
    fields = spread(spark, materialize(spark, df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.count("*").alias("n")), "fields"), "t")
    model, before = Model(), None
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model.counts, model.divides))

        def run(batches, shared=shared):
            known, signs, values, likelihood = Model(*shared.value), {}, {}, 0.0
            for b in batches:
                for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for piece in lattices(t):
                        likelihood += expected(piece, known, 1.0 if piece.contexts else n, values, signs)
            h = np.fromiter(values, dtype=np.uint64, count=len(values))
            n = np.fromiter(values.values(), dtype=np.float64, count=len(values))
            rows = np.concatenate([(h % BUCKETS).astype(np.int64), BUCKETS + ((h * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(12)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([None] * len(rows), type=pa.string()), pa.array(np.concatenate([n, n])), pa.array(np.zeros(len(rows)))], names=["b", "ctx", "n", "all"])
            names = list(signs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * (len(names) + 1), type=pa.int64()), pa.array([*names, None], type=pa.string()), pa.array([*(signs[c][0] for c in names), likelihood]), pa.array([*(signs[c][1] for c in names), 0.0])],
                names=["b", "ctx", "n", "all"],
            )

        rows = fields.mapInArrow(run, "b bigint, ctx string, n double, all double").groupBy("b", "ctx").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).toPandas()
        shared.unpersist()
        counts = np.zeros(2 * BUCKETS, dtype=np.float32)
        own = rows[rows["b"] >= 0]
        counts[own["b"].to_numpy(dtype=np.int64)] = own["n"].to_numpy()
        signs = rows[(rows["b"] < 0) & rows["ctx"].notna()]
        divides = {c: (n + PRIOR_WEIGHT * prior(c)) / (a + PRIOR_WEIGHT) for c, n, a in zip(signs["ctx"], signs["n"], signs["all"])}
        likelihood = float(rows[(rows["b"] < 0) & rows["ctx"].isna()]["n"].sum())
        model = Model(counts.reshape(2, BUCKETS), divides)
        if before is not None and abs(likelihood - before) <= CONVERGED * max(1.0, abs(before)):
            break
        before = likelihood
    return model


def split_values(spark: SparkSession, df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, val`` for each value of each distinct row of ``key, text``.

    Null, empty and blank fields have no rows. ``pos`` counts non-blank values
    from 1. Other columns are not read. The time of a field grows with the
    square of the doubtful delimiters between two certain ones.
    """
    rows = spread(spark, df.select(key, text), key, text).distinct()
    model = learn(spark, df, text)
    shared = spark.sparkContext.broadcast((model.counts, model.divides))
    kind_ = df.schema[key].dataType.simpleString()

    def run(batches):
        known = Model(*shared.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            found = [divide(t, known) for t in texts]
            n = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([p for k in n for p in range(1, k + 1)], type=pa.int32()), pa.array([v for f in found for v in f], type=pa.string())],
                names=[key, "pos", "val"],
            )

    return rows.mapInArrow(run, f"`{key}` {kind_}, pos int, val string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_values(spark, table(spark, sf_dir, "nucleo"), "row_id", "expected_values")


QUERIES = {"p3_found": p3_found}
ORACLE: dict[str, str] = {}
