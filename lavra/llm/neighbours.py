"""Problem 7: the most similar vectors of every vector.

Vectors are normalised and equal ones become one class. The classes of each model
are searched against each other: coarse lists by spherical k-means, in two levels
where there are many; residuals in four-bit product codes whose quantisation weighs
the error along the vector more than the error across it; scans of the codes by table
look-up over pairs of subspaces; the best of a scan scored again by bytes, and the
best of all scans of a vector exactly, on the vectors as given.

All vectors are queries. Lists have a bounded mean size and a query probes a fixed
number of them, so the work for a vector does not grow with their number. What
travels is a vector's bytes, once for each list it probes, not the vector. A list is
cut into cells of bounded size (blocks of codes x blocks of queries), so no list,
however hot, becomes one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, table
from .sample import bounded_sample

#: The length of each model's vectors.
DIMENSIONS = {"m-base": 96, "m-mini": 64}
K = 5
#: Most vectors of a model that are used to fit the first level of lists and the codebooks.
SAMPLE = 12_000
#: Mean vectors of a list; lists a query probes; lists from which on there are two levels; most lists, which all executors hold.
LIST_SIZE, PROBES, ONE_LEVEL, MOST_LISTS = 800, 8, 256, 1 << 17
#: Vectors for each second-level list that fit it.
FIT_EACH = 48
#: Dimensions of a subspace; with 16 centres each its code has four bits.
WIDTH = 2
#: Weight of the parallel error against the orthogonal one.
ETA = 3.0
#: Best of a scan of codes that are scored by bytes; best by bytes that are scored exactly.
RERANK, EXACT = 32, 12
#: Most that a similarity by bytes is off, many deviations wide.
BYTE_ERROR = 0.008
CELL_CODES, CELL_QUERIES, CHUNK = 8192, 16384, 256


def lists_for(n: int) -> tuple[int, int]:
    """Lists of the first and, below each of them, of the second level for ``n`` vectors."""
    lists = int(np.clip(-(-n // LIST_SIZE), 1, MOST_LISTS))
    if lists <= ONE_LEVEL:
        return lists, 1
    first = int(np.ceil(np.sqrt(lists)))
    return first, -(-lists // first)


@dataclass
class Index:
    """Coarse lists and codebooks of a model. ``children`` are the first and last list of each upper list; without upper lists all are one level."""

    coarse: np.ndarray  # (lists, d)
    books: np.ndarray  # (subspaces, 16, WIDTH)
    probes: int
    upper: np.ndarray | None = None  # (upper lists, d)
    children: np.ndarray | None = None  # (upper lists, 2)

    def assign(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The ``probes`` nearest lists of each vector, nearest first; fewer are filled with -1."""
        probes = min(probes or self.probes, len(self.coarse))
        if self.upper is None:
            return _top(x @ self.coarse.T, probes)
        near = _top(x @ self.upper.T, min(self.probes, len(self.upper)))
        score = np.full((len(x), near.shape[1] * int((self.children[:, 1] - self.children[:, 0]).max())), -np.inf, dtype=np.float32)
        lists = np.full(score.shape, -1, dtype=np.int64)
        wide = score.shape[1] // near.shape[1]
        for u in np.unique(near):
            rows, place = np.nonzero(near == u)
            a, z = self.children[u]
            cols = place[:, None] * wide + np.arange(z - a)
            score[rows[:, None], cols] = x[rows] @ self.coarse[a:z].T
            lists[rows[:, None], cols] = np.arange(a, z)
        return np.take_along_axis(lists, _top(score, min(probes, score.shape[1])), 1)

    def codes(self, x: np.ndarray, where: np.ndarray) -> np.ndarray:
        return quantise((x - self.coarse[where]), x, self.books)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best columns of each row, best first."""
    top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(score), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


def quantise(residual: np.ndarray, x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes that minimise |e|^2 + (ETA - 1) (e.u)^2, u the direction of the vector, by coordinate descent."""
    n, m = len(x), len(books)
    r = residual.reshape(n, m, WIDTH)
    u = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, m, WIDTH)
    codes = np.empty((n, m), dtype=np.uint8)
    parallel = np.empty((n, m), dtype=np.float32)
    for sweep in range(sweeps):
        total = parallel.sum(axis=1) if sweep else None
        for s in range(m):
            e = r[:, s, None, :] - books[s][None]  # (n, 16, WIDTH)
            along = np.einsum("nkw,nw->nk", e, u[:, s])
            loss = (e**2).sum(axis=2)
            if sweep:
                loss += (ETA - 1) * ((total - parallel[:, s])[:, None] + along) ** 2
            k = loss.argmin(axis=1)
            new = along[np.arange(n), k]
            if sweep:
                total += new - parallel[:, s]
            codes[:, s], parallel[:, s] = k, new
    return codes


def spherical_means(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by k-means on the sphere; an empty list takes a vector of the sample."""
    lists = max(1, min(lists, len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        total[size == 0] = x[rng.choice(len(x), int((size == 0).sum()))]
        centres = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def fit(x: np.ndarray, lists: int, probes: int = PROBES, seed: int = 7) -> Index:
    """Lists of one level and anisotropic codebooks from a sample ``x`` of unit vectors."""
    rng = np.random.default_rng(seed)
    coarse = spherical_means(x, lists, rng)
    return Index(coarse, fit_books(x, x - coarse[(x @ coarse.T).argmax(axis=1)], rng), min(probes, len(coarse)))


def fit_books(x: np.ndarray, r: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Anisotropic codebooks from vectors and their residuals."""
    m = x.shape[1] // WIDTH
    parts, u = r.reshape(len(x), m, WIDTH), x.reshape(len(x), m, WIDTH)
    pick = rng.choice(len(x), 16, replace=len(x) < 16)
    books = parts[pick].transpose(1, 0, 2).astype(np.float32).copy()
    for _ in range(4):
        codes = quantise(r, x, books, 2)
        e = parts - books[np.arange(m)[None], codes]
        along = (e * u).sum(axis=2)
        rest = along.sum(axis=1, keepdims=True) - along
        for s in range(m):
            # normal equations of each centre, other subspaces held
            lhs = np.eye(WIDTH)[None] + (ETA - 1) * u[:, s, :, None] * u[:, s, None, :]
            rhs = parts[:, s] + (ETA - 1) * u[:, s] * (rest[:, s] + (parts[:, s] * u[:, s]).sum(axis=1))[:, None]
            for k in range(16):
                own = codes[:, s] == k
                if own.any():
                    books[s, k] = np.linalg.solve(lhs[own].sum(axis=0), rhs[own].sum(axis=0))
                else:
                    books[s, k] = parts[rng.integers(len(x)), s]
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte; the last byte of an odd number holds one."""
    even = codes if codes.shape[1] % 2 == 0 else np.concatenate([codes, np.zeros((len(codes), 1), dtype=codes.dtype)], axis=1)
    return even[:, 0::2] * np.uint8(16) + even[:, 1::2]


def to_bytes(x: np.ndarray) -> np.ndarray:
    """Vectors as signed bytes, each with the scale that makes its greatest number 127; the scale is not needed for a unit vector's direction."""
    return np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-12))).astype(np.int8)


def from_bytes(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def scan(queries: np.ndarray, own: np.ndarray, pairs: np.ndarray, data: np.ndarray, ids: np.ndarray, index: Index, keep: int, floor: float):
    """The ``keep`` best of ``data`` for each query: a scan of four-bit codes, then scores by bytes.

    ``own`` are the queries' ids, which are not their own neighbours; ``pairs`` the
    packed codes and ``data`` the unit vectors of ``ids``. Yields (rows of queries,
    ids, similarities), those below ``floor`` and missing ones with the id 0 and
    the similarity -2.
    """
    m = len(index.books)
    half = -(-m // 2)
    books = index.books if m % 2 == 0 else np.concatenate([index.books, np.zeros((1, *index.books.shape[1:]), dtype=np.float32)])
    columns = [pairs[:, j].astype(np.intp) for j in range(half)]
    for at in range(0, len(queries), CHUNK):
        q = queries[at : at + CHUNK]
        parts = np.zeros((len(q), 2 * half * WIDTH), dtype=np.float32)
        parts[:, : q.shape[1]] = q
        dots = np.einsum("qmw,mkw->mkq", parts.reshape(len(q), 2 * half, WIDTH), books, optimize=True)  # (subspaces, 16, q)
        pair = (dots[0::2, :, None] + dots[1::2, None, :]).reshape(half, 256, len(q))
        scale = 32000.0 / max(1e-9, float(np.abs(dots).max(axis=1).sum(axis=0).max()))
        tables = np.rint(pair * scale).astype(np.int16)
        score = tables[0][columns[0]]
        for j in range(1, half):
            score += tables[j][columns[j]]
        cand = _top(score.T, min(RERANK + 1, len(ids)))  # the coarse part is the same for all vectors of a list
        near = np.einsum("qkd,qd->qk", data[cand], q, optimize=True)
        found = ids[cand]
        near[found == own[at : at + CHUNK, None]] = -2
        order = np.lexsort((found, -near), axis=1)[:, :keep]
        near, found = np.take_along_axis(near, order, 1), np.take_along_axis(found, order, 1)
        yield np.arange(at, at + len(q)), found, np.where(near >= floor, near, -2)


def usable(df: DataFrame, key: str, model: str, vector: str, dimensions: dict[str, int]) -> DataFrame:
    """``id, model, v, cid``: vectors of their model's length, of finite numbers and not all zero; ``cid`` is the class of equal vectors."""
    v = F.col(vector)
    length = F.create_map(*(F.lit(x) for kv in dimensions.items() for x in kv))[F.col(model)]
    fine = (F.size(v) == length) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    v = F.transform(v, lambda x: x + F.lit(0.0).cast("float"))  # one zero
    return df.filter(F.col(key).isNotNull() & fine).select(F.col(key).alias("id"), F.col(model).alias("model"), v.alias("v")).withColumn("cid", F.xxhash64("model", "v"))


def _matrix(column) -> np.ndarray:
    """Unit vectors of an Arrow list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _by_model(batch: pa.RecordBatch):
    """The parts of a batch that belong to one model each."""
    models = batch.column("model")
    for model in pa.compute.unique(models).to_pylist():
        yield model, batch.filter(pa.compute.equal(models, model))


def _bytes(column, kind) -> np.ndarray:
    """The rows of a binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def build(spark: SparkSession, rows: DataFrame) -> dict[str, Index]:
    """The index of each model, fitted on a bounded sample; a second level of lists is fitted on the executors, list by list."""
    counts = {r["model"]: r["n"] for r in rows.groupBy("model").agg(F.approx_count_distinct("cid", 0.02).alias("n")).collect()}
    indexes: dict[str, Index] = {}
    for model, n in counts.items():
        own = rows.filter(F.col("model") == model)
        x = np.unique(_matrix(bounded_sample(own.select("id", "v"), "id", SAMPLE, 7, ["id", "v"]).select("v").toArrow().column("v")), axis=0)
        first, second = lists_for(n)
        indexes[model] = fit(x, first) if second == 1 else two_levels(own, x, fit(x, first), n, second)
    return indexes


def two_levels(rows: DataFrame, x: np.ndarray, upper: Index, n: int, second: int, each: int = FIT_EACH) -> Index:
    """The index with ``second`` lists below each list of ``upper``; a list is fitted on at most ``2 * each * second`` vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(upper.coarse)
    share = min(1.0, each * second * len(upper.coarse) / max(1, n))
    h = F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(1 << 30))

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_matrix(b.column("v")) @ shared.value.T).argmax(axis=1).astype(np.int32)), b.column("h"), b.column("v")], names=["u", "h", "v"])

    some = rows.select("v", h.alias("h")).filter(F.col("h") < int(share * (1 << 30))).mapInArrow(place, "u int, h bigint, v array<float>")
    w = Window.partitionBy("u").orderBy("h")
    some = some.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * each * second).drop("r")

    def centres(t: pa.Table) -> pa.Table:
        u = t.column("u")[0].as_py()
        c = spherical_means(np.unique(_matrix(t.column("v")), axis=0), second, np.random.default_rng(u))
        return pa.table({"u": [u] * len(c), "c": c.tolist()}, schema=pa.schema([("u", pa.int32()), ("c", pa.list_(pa.float32()))]))

    # at most MOST_LISTS rows and a few
    found = some.groupBy("u").applyInArrow(centres, "u int, c array<float>").toArrow().to_pydict()
    below: list[list] = [[] for _ in upper.coarse]
    for u, c in zip(found["u"], found["c"]):
        below[u].append(c)
    below = [c or [upper.coarse[u].tolist()] for u, c in enumerate(below)]
    ends = np.cumsum([len(c) for c in below])
    children = np.stack([ends - [len(c) for c in below], ends], axis=1)
    index = Index(np.array([c for b in below for c in sorted(b)], dtype=np.float32), upper.books, PROBES, upper.coarse, children)
    index.books = fit_books(x, x - index.coarse[index.assign(x, 1)[:, 0]], np.random.default_rng(7))
    return index


def search(spark: SparkSession, rows: DataFrame, indexes: dict[str, Index], keep: int = EXACT, floor: float = -1.0) -> DataFrame:
    """``model, cid, near``: the ``keep`` classes most similar by bytes to each class, an array of (sim, cid) with the best first."""
    shared = spark.sparkContext.broadcast(indexes)

    def encode(batches):
        for b in batches:
            for model, part in _by_model(b):
                ix = shared.value[model]
                x = _matrix(part.column("v"))
                lists = ix.assign(x)
                codes, small = packed(ix.codes(x, lists[:, 0])), to_bytes(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("model"), part.column("cid"), pa.array([r.tobytes() for r in small]), pa.array([c.tobytes() for c in codes]), pa.array([r[r >= 0] for r in lists.astype(np.int32)], type=pa.list_(pa.int32()))],
                    names=["model", "cid", "x", "codes", "lists"],
                )

    coded = materialize(spark, rows.select("model", "cid", "v").mapInArrow(encode, "model string, cid bigint, x binary, codes binary, lists array<int>").dropDuplicates(["model", "cid"]), "codes")
    home = coded.groupBy("model", F.col("lists")[0].alias("l")).agg(F.count("*").alias("n"))
    asked = coded.select("model", F.explode("lists").alias("l")).groupBy("model", "l").agg(F.count("*").alias("m"))
    # at most MOST_LISTS rows a model
    sizes = F.broadcast(home.join(asked, ["model", "l"]).select("model", "l", F.ceil(F.col("n") / CELL_CODES).alias("nb"), F.ceil(F.col("m") / CELL_QUERIES).alias("qb")))
    h = F.xxhash64("cid", F.lit(1))
    base = coded.select("model", "cid", "x", "codes", F.col("lists")[0].alias("l")).join(sizes, ["model", "l"])
    base = base.select("model", "l", F.pmod(h, "nb").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("c"), "cid", "x", "codes")
    ask = coded.select("model", "cid", "x", F.explode("lists").alias("l")).join(sizes, ["model", "l"])
    ask = ask.select("model", "l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"), F.pmod(h, "qb").alias("c"), "cid", "x", F.lit(None).cast("binary").alias("codes"))
    near_type = pa.struct([("sim", pa.float32()), ("cid", pa.int64())])
    out = pa.schema([("model", pa.string()), ("cid", pa.int64()), ("near", pa.list_(near_type))])

    def cell(t: pa.Table) -> pa.Table:
        model = t.column("model")[0].as_py()
        is_base = t.column("codes").is_valid()
        data, ask_ = t.filter(is_base), t.filter(pa.compute.invert(is_base))
        if not len(data) or not len(ask_):
            return out.empty_table()
        ids, own = data.column("cid").to_numpy(), ask_.column("cid").to_numpy()
        every = list(scan(from_bytes(_bytes(ask_.column("x"), np.int8)), own, _bytes(data.column("codes"), np.uint8), from_bytes(_bytes(data.column("x"), np.int8)), ids, shared.value[model], keep, floor - BYTE_ERROR))
        found, sims = np.concatenate([f for _, f, _ in every]), np.concatenate([s for _, _, s in every])
        some = sims > -1.5
        n = some.sum(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(sims[some].astype(np.float32)), pa.array(found[some])], fields=list(near_type)))
        t = pa.table([pa.array([model] * len(own)), pa.array(own), lists], schema=out)
        return t.filter(pa.array(n > 0))

    found = base.unionByName(ask).groupBy("model", "l", "b", "c").applyInArrow(cell, "model string, cid bigint, near array<struct<sim:float,cid:bigint>>")
    best = F.array_sort(F.flatten(F.collect_list("near")), lambda a, b: F.when(a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).when(a["cid"] < b["cid"], -1).when(a["cid"] > b["cid"], 1).otherwise(0))
    return found.groupBy("model", "cid").agg(F.slice(best, 1, keep).alias("near"))  # PROBES x blocks short arrays a class


def cosine(a: str, b: str):
    """Cosine of two array columns, in double precision."""
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def exact_pairs(spark: SparkSession, rows: DataFrame, near: DataFrame, floor: float) -> DataFrame:
    """``model, cid, o, sim``: the exact similarity of each pair found, from the vectors as given; those below ``floor`` left out."""
    pairs = near.select("model", "cid", F.explode("near").alias("n")).select("model", F.least("cid", "n.cid").alias("cid"), F.greatest("cid", "n.cid").alias("o")).distinct()
    pairs = materialize(spark, pairs, "pairs")
    wanted = pairs.select("model", F.explode(F.array("cid", "o")).alias("cid")).distinct()
    vectors = rows.select("model", "cid", "v").join(wanted, ["model", "cid"], "left_semi").dropDuplicates(["model", "cid"])
    both = pairs.join(vectors, ["model", "cid"]).join(vectors.select("model", F.col("cid").alias("o"), F.col("v").alias("w")), ["model", "o"])
    scored = materialize(spark, both.select("model", "cid", "o", cosine("v", "w").alias("sim")).filter(F.col("sim") >= floor), "scored")
    return scored.unionByName(scored.select("model", F.col("o").alias("cid"), F.col("cid").alias("o"), "sim"))


def brute_pairs(rows: DataFrame, floor: float) -> DataFrame:
    """As ``exact_pairs``, but of all pairs of classes of a model: the exact mode, for small tables."""
    reps = rows.select("model", "cid", "v").dropDuplicates(["model", "cid"])
    both = reps.join(reps.select("model", F.col("cid").alias("o"), F.col("v").alias("w")), "model").filter("cid <> o")
    return both.select("model", "cid", "o", cosine("v", "w").alias("sim")).filter(F.col("sim") >= floor)


def nearest(
    spark: SparkSession, df: DataFrame, key: str, model: str, vector: str, dimensions: dict[str, int] | None = None, k: int = K, floor: float = -1.0, exact: bool = False, indexes: dict[str, Index] | None = None
) -> DataFrame:
    """``model, id, other, sim, rank``: the k most similar other vectors of each usable vector, of those with a similarity of at least ``floor``.

    Null, empty, zero and wrong-length vectors and those with null or
    not-a-number entries are no vectors. Repeated rows count once. Ties go to
    the smaller id. Copies come first: a copy's partners are the first k other
    members of its class, so a class of any size gives k pairs a member. A
    single vector of a model has no partner; an empty table has no rows. An id
    with several vectors has the partners of each. ``exact`` compares all pairs.
    """
    rows = usable(df, key, model, vector, dimensions or DIMENSIONS)
    members = materialize(spark, rows.select("id", "model", "cid").distinct(), "members")
    in_class = Window.partitionBy("model", "cid").orderBy("id")
    # the first k + 1 of each class: limited in each partition before they are shuffled
    first = members.withColumn("r", F.row_number().over(in_class)).filter(F.col("r") <= k + 1).groupBy("model", "cid").agg(F.array_sort(F.collect_list("id")).alias("first"))
    classes = materialize(spark, first.join(members.groupBy("model", "cid").agg(F.count("*").alias("size")), ["model", "cid"]), "classes")
    if exact:
        near = brute_pairs(rows, floor)
    else:
        near = exact_pairs(spark, rows, search(spark, rows, indexes or build(spark, rows), max(EXACT, k + 3), floor), floor)
    # members of the neighbouring classes, at most k + 1 each
    others = near.join(classes.select("model", F.col("cid").alias("o"), F.col("first").alias("members")), ["model", "o"])
    best = F.row_number().over(Window.partitionBy("model", "cid").orderBy(F.col("sim").desc(), F.col("members")[0]))
    others = others.withColumn("r", best).filter(F.col("r") <= k + 1)
    around = others.groupBy("model", "cid").agg(F.flatten(F.collect_list(F.transform("members", lambda i: F.struct((-F.col("sim")).alias("neg"), i.alias("id"))))).alias("around"))
    own = F.transform("first", lambda i: F.struct(F.lit(-1.0).alias("neg"), i.alias("id")))
    none = F.array().cast("array<struct<neg:double,id:bigint>>")
    pool = classes.join(around, ["model", "cid"], "left").select("model", "cid", "size", "first", F.slice(F.array_sort(F.concat(own, F.coalesce("around", none))), 1, k + 1).alias("pool"))
    single = pool.filter("size = 1").select("model", F.col("first")[0].alias("id"), "pool")
    copies = members.join(pool.filter("size > 1").select("model", "cid", "pool"), ["model", "cid"]).select("model", "id", "pool")
    mine = F.slice(F.filter("pool", lambda s: s["id"] != F.col("id")), 1, k)
    return single.unionByName(copies).select("model", "id", F.posexplode(mine).alias("p", "s")).select("model", "id", F.col("s.id").alias("other"), (-F.col("s.neg")).alias("sim"), (F.col("p") + 1).alias("rank"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearest(spark, table(spark, sf_dir, "vec0"), "chunk_rowid", "model_id", "embedding", floor=0.9 - 1e-6)
    return pairs.select(F.least("id", "other").alias("rowid_a"), F.greatest("id", "other").alias("rowid_b")).distinct()


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every usable vector."""
    return nearest(spark, table(spark, sf_dir, "vec0"), "chunk_rowid", "model_id", "embedding").select("model", "id", "other", "rank", F.round("sim", 5).alias("sim"))


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}
ORACLE: dict[str, str] = {}
