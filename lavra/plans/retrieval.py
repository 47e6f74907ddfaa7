"""Retrieval plane: lexical and vector search, fusion, boosts, routing, selection.

Questions are rows. Each stage is one set-oriented plan over all of them:
postings join on the term, exact vector search runs in blocks, fusion is an
aggregate, and only what one question has selected (at most its candidates) is
folded in an array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import FEEDBACK_STOP_WORDS, QUERY_STOP_WORDS, TITLE_STOP_WORDS, among, fold, index_tokens, query_phrases, words
from ..session import materialize, table
from .catalog import WORKSPACE_KEYS, retrievable, workspace_keys

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Parameters of the ranking functions and of selection.
K1, B, WEIGHT_TEXT, WEIGHT_PREFIX = 1.2, 0.75, 1.0, 0.5
#: Rows of all workspaces together that make one block of an exact vector search.
BLOCK_ROWS = 20_000
#: Queries that meet a block at once, and spare candidates whose distance is taken exactly.
ROWS_AT_ONCE, SPARE = 256, 8
CANDIDATES, RRF_K, TOP_K = 30, 1, 12
#: Texts and questions of a workspace that make one cell of the lexical search.
BLOCK_OF_TEXTS, BLOCK_OF_QUESTIONS = 2048, 8192


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("rowid", "document_id", "workspace_id", "chunk_set_id", "label", "parent_label", "kind", "item_number", "text", "context_prefix", "char_count", "embed").dropDuplicates(["rowid"])


def questions_of(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the workspace they ask by its id, name or call code; those that name no known one left out."""
    w = workspace_keys(spark, d).withColumnRenamed("key", "workspace")
    return table(spark, d, "nucleo").filter("question is not null").select("row_id", "workspace", "question").distinct().join(w, "workspace").select(F.col("row_id").alias("qid"), "workspace_id", "question")


def bm25(spark: SparkSession, questions: DataFrame, chunks: DataFrame, scope: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """``qid, rowid, score, rank``: the best k rows of each question's scope.

    Statistics are those of all rows; the scope only filters. A phrase of
    several tokens counts where they follow one another. Terms in more than
    half of the rows score almost nothing. Questions without words, and empty
    scopes, have no rows. Ties go to the smaller rowid.

    A question and its scope share common words with nearly every row, so scores are
    not joined pair by pair: the weights of a block of rows are a matrix, against which
    all questions of the workspace are summed; each block gives k rows a question.
    """
    asked = questions.select("qid", "workspace_id", "question", F.xxhash64("workspace_id", "question").alias("qn"))
    once = asked.select("qn", "workspace_id", "question").dropDuplicates(["qn"])
    phrases = once.select("qn", "workspace_id", F.explode(query_phrases(F.col("question"))).alias("phrase"))
    # what the questions ask for is written once: its size is known, so it is broadcast where it is small, and only its postings are kept
    none = F.array(F.lit(""))  # a sentinel that each row has once: it counts the rows
    wanted = phrases.select("phrase").distinct().unionByName(spark.range(1).select(none.alias("phrase"))).select(F.xxhash64(F.array_join("phrase", " ")).alias("key"), F.size("phrase").alias("size"), F.posexplode("phrase").alias("i", "term"))
    wanted = materialize(spark, wanted, "wanted")
    # all that follows of a row stays where its rowid is, and its text is read once
    t = chunks.select("rowid", "text", "context_prefix").dropDuplicates(["rowid"]).select("rowid", index_tokens(F.col("text")).alias("t"), index_tokens(F.col("context_prefix")).alias("p"))
    t = t.withColumn("len", F.size("t") + F.size("p"))
    both = F.concat(F.transform("t", lambda x, i: F.struct(F.lit(WEIGHT_TEXT).alias("weight"), i.alias("pos"), x.alias("term"))), F.transform("p", lambda x, i: F.struct(F.lit(WEIGHT_PREFIX).alias("weight"), i.alias("pos"), x.alias("term"))), F.array(F.struct(F.lit(WEIGHT_TEXT).alias("weight"), F.lit(-2).alias("pos"), F.lit("").alias("term"))))
    hits = t.select("rowid", "len", F.explode(both).alias("x")).select("rowid", "len", "x.*").join(wanted, "term")
    # the tokens of a phrase must agree on where it begins
    whole = hits.groupBy("rowid", "len", "key", "size", "weight", (F.col("pos") - F.col("i")).alias("at")).agg(F.count("*").alias("c")).filter("c = size")
    inside = scope.groupBy("rowid").agg(F.collect_set("workspace_id").alias("inside"))
    tf = materialize(spark, whole.groupBy("rowid", "len", "key").agg(F.sum("weight").alias("tf")).join(inside, "rowid", "left"), "tf")
    sentinel = F.col("key") == F.xxhash64(F.lit(""))
    stats = tf.filter(sentinel).agg(F.count("*").alias("n_rows"), F.avg("len").alias("avg_len"))  # one row
    tf = tf.filter(~sentinel)
    df = tf.groupBy("key").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = materialize(spark, df.join(F.broadcast(stats)).select("key", "avg_len", F.when(raw <= 0, 1e-6).otherwise(raw).alias("idf")), "idf")
    w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    rows, many = scope.select("workspace_id", "rowid").distinct().groupBy("workspace_id").agg(F.ceil(F.count("*") / BLOCK_OF_TEXTS).alias("blocks")), once.groupBy("workspace_id").agg(F.ceil(F.count("*") / BLOCK_OF_QUESTIONS).alias("asking"))
    sizes = materialize(spark, rows.join(many, "workspace_id"), "cells")  # a row a workspace
    block = lambda c, n: F.pmod(F.xxhash64(c), n)
    weights = tf.join(idf, "key").select("rowid", "key", w.alias("w"), F.explode("inside").alias("workspace_id")).join(sizes, "workspace_id")
    weights = weights.select("workspace_id", block("rowid", F.col("blocks")).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("a"), "rowid", "key", "w")
    keys = phrases.groupBy("qn", "workspace_id").agg(F.collect_set(F.xxhash64(F.array_join("phrase", " "))).alias("keys")).join(sizes, "workspace_id")
    keys = keys.select("workspace_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), block("qn", F.col("asking")).alias("a"), "qn", "keys")

    def best(_, x: pa.Table, y: pa.Table) -> pa.Table:
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(x) and len(y):
            lists = y.column("keys").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            terms, flat = np.unique(flat, return_inverse=True)
            ids, col = np.unique(x.column("rowid").to_numpy(), return_inverse=True)
            key = x.column("key").to_numpy()
            at = np.minimum(np.searchsorted(terms, key), len(terms) - 1)
            ok = terms[at] == key
            matrix = np.zeros((len(terms), len(ids)))
            matrix[at[ok], col[ok]] = x.column("w").to_numpy()[ok]
            for i, qn in enumerate(y.column("qn").to_numpy()):
                score = matrix[flat[ends[i] : ends[i + 1]]].sum(axis=0)
                rounded = np.round(score, 9)
                least = np.partition(rounded, -k)[-k] if len(ids) > k else -1.0
                some = np.flatnonzero((score > 0) & (rounded >= least))
                some = some[np.lexsort((ids[some], -rounded[some]))[:k]]
                out.append((np.full(len(some), qn), ids[some], score[some]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"qn": cols[0], "rowid": cols[1], "score": cols[2]})

    cell = ["workspace_id", "b", "a"]
    found = keys.groupBy(*cell).cogroup(weights.groupBy(*cell)).applyInArrow(lambda c, y, x: best(c, x, y), "qn bigint, rowid bigint, score double")
    rank = F.row_number().over(W.partitionBy("qn").orderBy(F.round("score", 9).desc(), "rowid"))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return asked.select("qid", "qn").join(top, "qn").select("qid", "rowid", "score", "rank")


def scope_of(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of retrievable documents, without their texts, with what is asked of the document."""
    docs = retrievable(table(spark, d, "documents")).select("document_id", "workspace_id", "precedence", "doc_type", "doc_kind")
    c = table(spark, d, "chunks").select("rowid", "document_id", "chunk_set_id", "label", "parent_label", "kind", "item_number", "char_count", "embed")
    return c.dropDuplicates(["rowid"]).join(docs, "document_id")


_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower({0})), '\\p{{M}}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w<>'')"
_EXACT = "R\\$\\s?\\d[\\d.]*(?:,\\d+)?|\\d{1,2}/\\d{1,2}/\\d{2,4}|\\d+(?:\\.\\d+)+"
_VARIANTS = """case when length(w)<3 then [w] when suffix(w,'ões') or suffix(w,'ãos') then [w, left(w,length(w)-3)||'ão'] when suffix(w,'is') and length(w)>4 then [w, left(w,length(w)-2)||'l']
  when suffix(w,'ns') then [w, left(w,length(w)-2)||'m'] when suffix(w,'res') or suffix(w,'zes') or suffix(w,'ses') then [w, left(w,length(w)-2), left(w,length(w)-1)] when suffix(w,'s') then [w, left(w,length(w)-1)]
  when suffix(w,'ão') then [w, left(w,length(w)-2)||'ões', left(w,length(w)-2)||'ãos'] when suffix(w,'l') then [w, left(w,length(w)-1)||'is'] when suffix(w,'m') then [w, left(w,length(w)-1)||'ns']
  when suffix(w,'r') or suffix(w,'z') then [w, w||'es'] else [w, w||'s'] end"""
_STOPS = "(" + ",".join(f"'{w}'" for w in QUERY_STOP_WORDS) + ")"
#: The lexical search in SQL: ranked(qid, rowid, score, rank) for the questions q(qid, workspace_id, question).
_BM25 = f"""w1 as (select *, list_filter(regexp_split_to_array(lower(regexp_replace(question, '{_EXACT}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w)>=2) tk from q),
 w2 as (select *, list_filter(tk, lambda w: w not in {_STOPS}) ct from w1),
 ph as (select qid, workspace_id, {_TOKENS.format("x")} phrase from (select qid, workspace_id, unnest(regexp_extract_all(question, '{_EXACT}', 0)) x from q)
   union all select qid, workspace_id, {_TOKENS.format("v")} from (select qid, workspace_id, unnest(case when regexp_matches(w,'^\\p{{N}}+$') then [w] else {_VARIANTS} end) v from (select qid, workspace_id, unnest(case when len(ct)>0 then ct else tk end) w from w2))),
 keys as (select distinct qid, workspace_id, array_to_string(phrase,' ') as phrase_key, phrase from ph where len(phrase)>0),
 wanted as (select phrase_key, len(phrase) size, unnest(phrase) term, generate_subscripts(phrase,1) i from (select distinct phrase_key, phrase from keys)),
 ch as (select distinct on (rowid) rowid, document_id, {_TOKENS.format("coalesce(text,'')")} t, {_TOKENS.format("coalesce(context_prefix,'')")} p from chunks),
 idx as (select rowid, 1.0::double wt, unnest(t) term, generate_subscripts(t,1) pos from ch union all select rowid, 0.5::double, unnest(p), generate_subscripts(p,1) from ch),
 st as (select count(*) n_rows, avg(len(t)+len(p)) avg_len from ch),
 tf as (select phrase_key, h.rowid, sum(wt) tf from (select phrase_key, wanted.size, idx.rowid, wt, pos-i from wanted join idx using (term) group by all having count(*)=size) h group by 1,2),
 idf as (select phrase_key, case when ln((n_rows-df+0.5)/(df+0.5))<=0 then 1e-6 else ln((n_rows-df+0.5)/(df+0.5)) end idf, avg_len from (select phrase_key, count(*) df from tf group by 1), st),
 wg as (select tf.phrase_key, tf.rowid, idf*tf*2.2/(tf+1.2*(0.25+0.75*(len(ch.t)+len(ch.p))/avg_len)) w from tf join idf using (phrase_key) join ch on ch.rowid=tf.rowid),
 sc as (select ch.rowid, d.workspace_id from ch join documents d on d.document_id=ch.document_id where d.status='ready' and d.is_current),
 tot as (select keys.qid, wg.rowid, sum(w) score from keys join wg using (phrase_key) join sc on sc.rowid=wg.rowid and sc.workspace_id=keys.workspace_id group by 1,2),
 ranked as (select *, row_number() over (partition by qid order by round(score,9) desc, rowid) as rank from tot qualify rank<={CANDIDATES})"""
_ASKED = f"{WORKSPACE_KEYS}, q as (select distinct n.row_id qid, k.ws workspace_id, n.question from nucleo n join k on k.key=n.workspace where n.question is not null)"


@query(f"with {_ASKED}, {_BM25} select qid, rowid, rank, round(score,6) as score from ranked")
def bm25_search(spark, d):
    """The lexical candidates of every question."""
    return bm25(spark, questions_of(spark, d), chunks_of(spark, d), scope_of(spark, d)).select("qid", "rowid", "rank", F.round("score", 6).alias("score"))


def unit(v):
    return F.transform(v, lambda x: x.cast("double"))


def exact_knn(spark: SparkSession, queries: DataFrame, vectors: DataFrame, k: int, within: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """``qid, rowid, dist, rank`` and the columns ``within``: the k nearest vectors by Euclidean distance that agree with the query in these.

    Queries and vectors meet by these columns in blocks of bounded size; each block
    gives k rows a query. Vectors of other lengths than the query's do not count.
    """
    blocks, asking = -(-vectors.count() // BLOCK_ROWS) or 1, -(-queries.count() // BLOCK_ROWS) or 1
    own = [F.col(c).alias(c) for c in within]  # columns apart from those of the vectors, where both come from one table
    a = queries.select("qid", *own, "q", F.pmod(F.xxhash64("qid"), F.lit(asking)).alias("qb"))
    b = vectors.select(*within, "rowid", "v", F.pmod(F.xxhash64("rowid"), F.lit(blocks)).alias("vb"))
    left = a.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = b.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asking - 1)).cast("array<bigint>")))

    def near(keys, x: pa.Table, y: pa.Table) -> pa.Table:
        out, ids = [], y.column("rowid").to_numpy()
        sizes, asked = np.asarray(pa.compute.list_value_length(y.column("v"))), np.asarray(pa.compute.list_value_length(x.column("q")))
        for n in np.intersect1d(sizes, asked):
            own, mine = np.flatnonzero(sizes == n), np.flatnonzero(asked == n)
            m, q = (c.take(pa.array(r)).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(r), -1) for c, r in ((y.column("v"), own), (x.column("q"), mine)))
            for at in range(0, len(q), ROWS_AT_ONCE):
                part = q[at : at + ROWS_AT_ONCE]
                # a product of matrices finds the candidates, the distances of these are exact
                rough = (m**2).sum(axis=1)[None] - 2 * part @ m.T
                top = np.argpartition(rough, min(k + SPARE, len(m)) - 1, axis=1)[:, : k + SPARE]
                dist = np.sqrt(((m[top] - part[:, None]) ** 2).sum(axis=2))
                order = np.lexsort((ids[own][top], dist), axis=1)[:, :k]
                out.append((np.repeat(mine[at : at + len(part)], order.shape[1]), np.take_along_axis(ids[own][top], order, 1).ravel(), np.take_along_axis(dist, order, 1).ravel()))
        row, rowid, dist = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        shared = [pa.array([key.as_py()] * len(row), type=pa.string()) for key in keys[: len(within)]]
        return pa.table([x.column("qid").take(pa.array(row)), pa.array(rowid), pa.array(dist), *shared], names=["qid", "rowid", "dist", *within])

    keys = [*within, "qb", "vb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(near, "qid bigint, rowid bigint, dist double" + "".join(f", {c} string" for c in within))
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*within, "qid").orderBy(F.round("dist", 9), "rowid"))).filter(F.col("rank") <= k)


def model_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``rowid, model_id, workspace_id, v``: the whole, finite vectors that are not all zero of every model, one a chunk and model, the last written.

    A model's length is the one most of its vectors have.
    """
    v = F.col("embedding")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    t = table(spark, d, "vec0").filter(F.col("chunk_rowid").isNotNull() & F.col("workspace_id").isNotNull() & F.col("model_id").isNotNull() & good).withColumn("n", F.size(v))
    own = t.groupBy("model_id", "n").agg(F.count("*").alias("c")).groupBy("model_id").agg(F.max_by("n", F.struct("c", "n")).alias("n"))
    last = F.max_by(F.struct("workspace_id", "embedding"), F.struct("created_at", "embedding"))
    rows = t.join(own, ["model_id", "n"], "left_semi").groupBy(F.col("chunk_rowid").alias("rowid"), "model_id").agg(last.alias("x"))
    return rows.select("rowid", "model_id", "x.workspace_id", F.col("x.embedding").alias("v"))


_GOOD = "chunk_rowid is not null and workspace_id is not null and model_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)))=0 and len(list_filter(embedding, lambda x: x<>0))>0"


@query(f"""with t as (select *, len(embedding) n from vec0 where {_GOOD}), own as (select model_id, n from (select model_id, n, count(*) c from t group by 1,2) qualify row_number() over (partition by model_id order by c desc, n desc)=1),
 v as (select chunk_rowid rowid, t.model_id, workspace_id, embedding v from t join own using (model_id, n) qualify row_number() over (partition by chunk_rowid, t.model_id order by created_at desc, embedding desc)=1),
 s as (select q.rowid qid, q.model_id, c.rowid, list_distance(q.v::double[], c.v::double[]) dist from v q join v c on q.workspace_id=c.workspace_id and q.model_id=c.model_id where q.rowid%20=0)
 select qid, model_id, rowid, round(dist,5) as dist, row_number() over (partition by qid, model_id order by round(dist,9), rowid) as rank from s qualify rank<=10""")
def knn_search(spark, d):
    """The ten nearest vectors of the same workspace and model for every query vector (ids divisible by 20) of every model."""
    v = materialize(spark, model_vectors(spark, d), "vectors")
    q = v.filter("rowid % 20 = 0").select(F.col("rowid").alias("qid"), "model_id", "workspace_id", F.col("v").alias("q"))
    return exact_knn(spark, q, v, 10, ("workspace_id", "model_id")).select("qid", "model_id", "rowid", F.round("dist", 5).alias("dist"), "rank")


def rrf_of(k: int = RRF_K) -> Column:
    """The sum of 1 / (k + rank) over the rows of a group, added in the order of the lists."""
    terms = F.array_sort(F.collect_list(F.struct("list_no", (1.0 / (k + F.col("rank"))).alias("t"))))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["t"])


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """``qid, rowid, rrf``: reciprocal ranks over all lists."""
    return lists.groupBy("qid", "rowid").agg(rrf_of(k).alias("rrf"))


def select_quota(ranked: DataFrame, principal: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The best ``top_k`` of each question; with two principal documents or more, each has a quota first.

    ``ranked`` has qid, rowid, document_id and pos; ``principal`` qid, document_id.
    """
    n = principal.groupBy("qid").agg(F.count("*").alias("docs"))
    r = ranked.join(n, "qid", "left").join(principal.withColumn("main", F.lit(True)), ["qid", "document_id"], "left")
    quota = F.greatest(F.lit(1), F.floor(F.lit(top_k) / (2 * F.col("docs"))))
    r = r.withColumn("in_doc", F.row_number().over(W.partitionBy("qid", "document_id").orderBy("pos")))
    first = F.coalesce((F.col("docs") >= 2) & F.col("main") & (F.col("in_doc") <= quota), F.lit(False))
    r = r.withColumn("order", F.row_number().over(W.partitionBy("qid").orderBy(F.when(first, 0).otherwise(1), "pos")))
    return r.filter(F.col("order") <= top_k).select("qid", "rowid", "document_id", "pos")


_TOK = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(title)), '\\p{M}', '', 'g'), '[^\\p{L}\\p{N}]+'), lambda t: length(t)>=3 and t not in (" + ",".join(f"'{w}'" for w in TITLE_STOP_WORDS) + ")))"


@query(f"""with t as (select workspace_id, document_id, unnest({_TOK}) token from documents where status='ready' and is_current and title is not null),
 n as (select workspace_id, count(*) docs from documents where status='ready' and is_current group by 1), o as (select workspace_id, token, count(*) owners from t group by 1,2)
 select t.workspace_id, t.document_id, t.token, o.owners from t join o using (workspace_id, token) join n using (workspace_id) where docs=1 or owners<docs""")
def title_tokens(spark, d):
    """Distinctive words of each title and how many titles of the workspace have them."""
    docs = retrievable(table(spark, d, "documents"))
    n = docs.groupBy("workspace_id").agg(F.count("*").alias("docs"))
    own = F.array_distinct(F.filter(words(fold(F.col("title")), 3), lambda t: ~among(t, TITLE_STOP_WORDS)))
    t = docs.filter("title is not null").select("workspace_id", "document_id", F.explode(own).alias("token"))
    o = t.groupBy("workspace_id", "token").agg(F.count("*").alias("owners"))
    return t.join(o, ["workspace_id", "token"]).join(n, "workspace_id").filter("docs = 1 or owners < docs").select("workspace_id", "document_id", "token", "owners")


@query()
def named_documents(spark, d):
    """Documents a question names: two distinctive title words, or one that no other title has; with amendments both ways."""
    t = title_tokens(spark, d)
    q = questions_of(spark, d).select("qid", "workspace_id", F.explode(F.array_distinct(words(fold(F.col("question")), 3))).alias("token"))
    hit = q.join(t, ["workspace_id", "token"]).groupBy("qid", "document_id").agg(F.count("*").alias("n"), F.min("owners").alias("o")).filter("n >= 2 or o = 1").select("qid", "document_id")
    a = table(spark, d, "documents").filter("amends_document_id is not null").select("document_id", "amends_document_id")
    up = hit.join(a, "document_id").select("qid", F.col("amends_document_id").alias("document_id"))
    down = hit.join(a.select(F.col("document_id").alias("x"), F.col("amends_document_id").alias("document_id")), "document_id").select("qid", F.col("x").alias("document_id"))
    return hit.union(up).union(down).distinct()


_FW = "list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(text)), '\\p{M}', '', 'g'), '[^\\p{L}\\p{N}]+'), lambda t: length(t)>=4 and not regexp_matches(t,'^\\d+$') and t not in (" + ",".join(f"'{w}'" for w in FEEDBACK_STOP_WORDS) + "))"


@query(f"""with c as (select distinct on (rowid) rowid, document_id, text from chunks where text is not null), t as (select document_id, rowid, unnest({_FW}) w from c),
 n as (select document_id, count(*) n from c group by 1), f as (select document_id, w, count(distinct rowid) df, count(*) tf from t group by 1,2)
 select document_id, w as term, round(tf*ln((n+1.0::double)/(df+1)),6) as weight from f join n using (document_id) where n>df qualify row_number() over (partition by document_id order by weight desc, w)<=8""")
def feedback_terms(spark, d):
    """``distinctive_terms`` of all chunks with text, whatever their script."""
    return distinctive_terms(table(spark, d, "chunks").filter("text is not null"))


def distinctive_terms(chunks: DataFrame) -> DataFrame:
    """The eight terms of each document that set its chunks apart: frequency times ln((n + 1) / (df + 1)).

    Chunks travel by blocks of neighbouring rowids, which mostly are of one
    document, so that its terms add up before they are shuffled.
    """
    block = F.floor(F.col("rowid") / 64)
    c = chunks.select("document_id", "rowid", "text", block.alias("block")).repartition("block").dropDuplicates(["block", "rowid"])
    w = F.filter(words(fold(F.col("text")), 4), lambda t: ~t.rlike(r"^\d+$") & ~among(t, FEEDBACK_STOP_WORDS))
    t = c.select("document_id", "block", "rowid", F.explode(w).alias("term")).groupBy("document_id", "term", "block", "rowid").agg(F.count("*").alias("k")).groupBy("document_id", "term").agg(F.count("*").alias("df"), F.sum("k").alias("tf"))
    n = c.groupBy("document_id").agg(F.count("*").alias("n"))
    weight = F.round(F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1)), 6)
    r = t.join(n, "document_id").filter("n > df").select("document_id", "term", weight.alias("weight"))
    return r.withColumn("r", F.row_number().over(W.partitionBy("document_id").orderBy(F.col("weight").desc(), "term"))).filter("r <= 8").drop("r")
