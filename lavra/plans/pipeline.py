"""Retrieval in one pipeline: lists, feedback, fusion, boosts, routing, selection, expansion, budget, order.

Lists, fusion and boosts are set-oriented over all questions. What one question has
left (its candidates, at most a few hundred rows, and their parents) is decided by
plain rules, in blocks of questions that share what is known of the chunks.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import FEEDBACK_STOP_WORDS, IDENTIFIER, among, fold, words
from ..session import materialize, table
from .kit import collector
from .retrieval import _ASKED, _BM25, _FW, bm25, chunks_of, exact_knn, model_vectors, named_documents, questions_of, rrf, rrf_of, scope_of

query, QUERIES, ORACLE = collector()


@dataclass
class Config:
    """Knobs of the pipeline and their defaults."""

    mode: str = "hybrid"
    candidates: int = 30
    rrf_k: int = 1
    top_k: int = 12
    budget: int = 28000
    max_chars: int = 1600
    expand: bool = True
    section_boost: bool = False
    routing: bool = True
    prf: bool = False
    prf_docs: int = 5
    prf_terms: int = 8
    rerank_candidates: int = 40


#: Candidates of the first round that make the sample of document frequencies.
SAMPLE_OF_CANDIDATES = 200
#: Questions of a workspace that meet their candidates at once.
BLOCK_OF_ASKED = 512


def identifier_pattern(i: Column) -> Column:
    """A pattern for an identifier as a whole token: amounts, acronyms, dates and dotted numbers each with their own borders."""
    escape = lambda c: F.regexp_replace(c, r"([.*+?^${}()|\[\]\\/])", r"\\$1")
    return (
        F.when(i.startswith("R$"), F.concat(F.lit(r"R\$\s?"), escape(F.regexp_replace(i, r"^R\$\s?", "")), F.lit(r"(?![\d,])")))
        .when(i.rlike(r"^\p{Lu}+$"), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), escape(i), F.lit(r"(?![\p{L}\p{N}])")))
        .otherwise(F.concat(F.lit(r"(?<![\d./])"), escape(i), F.lit(r"(?![\d/]|\.\d)")))
    )


def by_blocks(spark: SparkSession, questions: DataFrame) -> DataFrame:
    """``qid, workspace_id, block``: blocks of neighbouring questions, which share most of their candidates, so that what is asked of a chunk travels once a block."""
    home = questions.groupBy("qid").agg(F.min("workspace_id").alias("workspace_id"))
    many = home.groupBy("workspace_id").agg(F.ceil(F.count("*") / BLOCK_OF_ASKED).alias("n"))  # a row a workspace
    return materialize(spark, home.join(F.broadcast(many), "workspace_id").select("qid", "workspace_id", F.pmod(F.xxhash64("qid"), F.col("n")).alias("block")), "blocks")


def feedback(spark: SparkSession, lists: DataFrame, questions: DataFrame, chunks: DataFrame, blocks: DataFrame, docs: int = 5, terms: int = 8) -> DataFrame:
    """``qid, term, place``: the terms that set the best candidates of a question apart from the others, its own words left out.

    ``lists`` has qid, list_no, rowid and rank. Each occurrence in the best ``docs`` of each list adds
    ln((n + 1) / (df + 1)), counted over the first 200 distinct candidates. Equal weights go by first appearance.

    A block of questions (``by_blocks``) meets the words of its candidates, each chunk once; terms are counted there, not as rows.
    """
    at = F.struct("list_no", "rank")
    first = lists.groupBy("qid", "rowid").agg(F.min(at).alias("k"), F.min(F.when(F.col("rank") <= docs, at)).alias("t"))
    place = F.row_number().over(W.partitionBy("qid").orderBy("k"))
    sample = first.withColumn("p", place).filter(F.col("p") <= SAMPLE_OF_CANDIDATES)
    tokens = lambda c: F.filter(words(fold(c), 4), lambda t: ~t.rlike(r"^\d+$") & ~among(t, FEEDBACK_STOP_WORDS))
    cell = ["workspace_id", "block"]
    sample = materialize(spark, sample.join(blocks, "qid").select(*cell, "qid", "rowid", F.col("t.list_no").alias("list_no"), F.col("t.rank").alias("rank")), "sample")
    here = [F.col(c).alias(c) for c in cell]  # columns apart from those of the sample
    texts = sample.select(*cell, "rowid").distinct().join(chunks.filter("text is not null").select("rowid", tokens(F.col("text")).alias("w")), "rowid").select(*here, F.lit(False).alias("own"), F.col("rowid").alias("id"), "w")
    own = questions.filter("question is not null").select("qid", tokens(F.col("question")).alias("w")).join(blocks, "qid").select(*cell, F.lit(True).alias("own"), F.col("qid").alias("id"), "w")

    def best(_, x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"qid": pa.array([], type=pa.int64()), "term": pa.array([], type=pa.string()), "place": pa.array([], type=pa.int32())})
        out: list[tuple] = []
        w = y.column("w").combine_chunks()
        coded = w.flatten().dictionary_encode()
        flat, ends, ids, mine = coded.indices.to_numpy(), w.offsets.to_numpy() - w.offsets[0].as_py(), y.column("id").to_numpy(), y.column("own").to_numpy()
        said = lambda i: flat[ends[i] : ends[i + 1]]
        once = [np.unique(said(i)) for i in range(len(ids))]
        texts = {ids[i]: i for i in np.flatnonzero(~mine)}
        asking: dict[int, list[int]] = {}
        for i in np.flatnonzero(mine):
            asking.setdefault(ids[i], []).append(i)
        x = x.sort_by([("qid", "ascending"), ("list_no", "ascending"), ("rank", "ascending")])  # those beyond the best come last
        qids, rows = x.column("qid").to_numpy(), [texts.get(r) for r in x.column("rowid").to_numpy()]
        good = np.asarray(x.column("list_no").is_valid())
        edges = np.flatnonzero(np.diff(qids, prepend=qids[:1] - 1, append=qids[-1:] + 1))
        for a, b in zip(edges[:-1], edges[1:]):
            top = [said(r) for r, g in zip(rows[a:b], good[a:b]) if g and r is not None]
            if not top or qids[a] not in asking:
                continue
            t, at, tf = np.unique(np.concatenate(top), return_index=True, return_counts=True)
            df = np.bincount(np.concatenate([once[r] for r in rows[a:b] if r is not None]), minlength=len(coded.dictionary))[t]
            keep = np.concatenate([np.flatnonzero((b - a > df) & ~np.isin(t, once[i])) for i in asking[qids[a]]])
            weight = np.round(tf[keep] * np.log((b - a + 1.0) / (df[keep] + 1)), 9)
            keep = keep[np.lexsort((at[keep], -weight))[:terms]]
            out.append((np.full(len(keep), qids[a]), t[keep], np.arange(1, len(keep) + 1)))
        qid, term, place = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3
        return pa.table({"qid": qid, "term": coded.dictionary.take(pa.array(term)), "place": pa.array(place, type=pa.int32())})

    return sample.groupBy(*cell).cogroup(texts.unionByName(own).groupBy(*cell)).applyInArrow(best, "qid bigint, term string, place int")


def dense_lists(spark: SparkSession, lists: DataFrame, vectors: DataFrame, scope: DataFrame, k: int = 30) -> DataFrame:
    """``qid, rowid, rank``: for each question the neighbours, among the embedded chunks in scope, of its best lexical hit that has a vector.

    The hit stands in for the question, whose embedding comes from outside. Vectors of several models stay apart;
    the hit's first model by name counts.
    """
    first = vectors.groupBy("rowid").agg(F.min("model_id").alias("model_id"))
    hits = lists.join(first.select("rowid"), "rowid", "left_semi").groupBy("qid").agg(F.min_by("rowid", "rank").alias("rowid"))
    asked = materialize(spark, hits.join(first, "rowid").join(vectors, ["rowid", "model_id"]).select("qid", "model_id", "workspace_id", F.col("v").alias("q")), "asked")
    inside = materialize(spark, vectors.join(scope.filter("embed").select("rowid"), "rowid", "left_semi"), "inside")
    return exact_knn(spark, asked, inside, k, ("workspace_id", "model_id")).select("qid", "rowid", "rank")


def asked_variants(questions: DataFrame, variants: DataFrame) -> DataFrame:
    """``qid, workspace_id, list_no, question``: what the variants of questions ask besides these."""
    v = variants.select("qid", "no", F.trim("text").alias("text")).filter("text <> ''").groupBy("qid", "text").agg(F.min("no").alias("no"))
    return v.join(questions, "qid").filter(F.col("text") != F.trim("question")).select("qid", "workspace_id", (F.col("no") + 2).alias("list_no"), F.col("text").alias("question"))


def lexical_lists(spark: SparkSession, asked: DataFrame, chunks: DataFrame, scope: DataFrame, config: Config) -> DataFrame:
    """``qid, list_no, kind, rowid, rank``: the lexical list of everything asked."""
    one = asked.withColumn("q", F.struct("qid", "list_no"))
    found = bm25(spark, one.select(F.col("q").alias("qid"), "workspace_id", "question"), chunks, scope, config.candidates)
    lexical = found.select("qid.qid", "qid.list_no", "rowid", "rank").withColumn("kind", F.when(F.col("list_no") == 0, "bm25").otherwise("extra"))
    return materialize(spark, lexical.select("qid", "list_no", "kind", "rowid", "rank"), "lexical")


def search_lists(spark: SparkSession, questions: DataFrame, chunks: DataFrame, scope: DataFrame, vectors: DataFrame | None, config: Config, variants: DataFrame | None = None) -> DataFrame:
    """``qid, list_no, kind, rowid, rank``: the lexical and dense list of each question (0, 1) and a lexical list of each variant (from 2 on).

    ``variants`` has qid, no (from 0) and text; equal ones and those equal to the question count once or not at all.
    """
    asked = questions.select("qid", "workspace_id", F.lit(0).alias("list_no"), "question")
    if variants is not None:
        asked = asked.unionByName(asked_variants(questions, variants))
    lexical = spark.createDataFrame([], "qid bigint, list_no int, kind string, rowid bigint, rank int")
    if config.mode != "dense":
        lexical = lexical_lists(spark, asked, chunks, scope, config)
    if config.mode == "bm25" or vectors is None:
        return lexical
    base = lexical.filter("list_no = 0").select("qid", "rowid", "rank")
    if config.mode == "dense":
        base = bm25(spark, questions, chunks, scope, config.candidates).select("qid", "rowid", "rank")
    dense = dense_lists(spark, base, vectors, scope, config.candidates).select("qid", F.lit(1).alias("list_no"), F.lit("dense").alias("kind"), "rowid", "rank")
    return lexical.unionByName(dense)


def assemble(rows: list[dict], parents: dict[tuple, dict], named: set[str], principal: int, config: dict, rerank: dict[int, float] | None = None) -> list[dict]:
    """Decides what of one question's candidates becomes its context.

    ``rows`` are candidates with rrf, flags and what the rules need; ``parents`` the chunks they may expand to, by
    (document, set, label). Returns all candidates, parents that were added too, each with selected, expanded_to and place.
    """
    work = {r["rowid"]: dict(r, selected=False, expanded_to=None, rerank=(rerank or {}).get(r["rowid"])) for r in rows}
    key = lambda r, label: (r["document_id"], r["chunk_set_id"], label)
    order = lambda r: (-(r["rerank"] if r["rerank"] is not None else float("-inf")), -round(r["rrf"], 9), r["rowid"])
    one = 1 / (config["rrf_k"] + 1)
    if config["mode"] == "hybrid":
        for r in work.values():
            r["rrf"] += one if r["identifier"] else 0.0
    if config["section_boost"]:
        best = sorted((r for r in work.values() if r["kind"] == "section"), key=order)[:3]
        for r in work.values():
            if r["kind"] != "section":
                path = r["section_path"] or ""
                hit = next((i for i, s in enumerate(best) if r["parent_label"] and r["parent_label"] == s["label"] or s["heading"] and s["heading"] in path or s["item_number"] and path.startswith(s["item_number"] + ". ")), None)
                r["rrf"] += 1 / (config["rrf_k"] + hit + 1) if hit is not None else 0.0
    if config["routing"] and named:
        for r in work.values():
            r["rrf"] += one if r["document_id"] in named else 0.0
    ranked = sorted(work.values(), key=order)
    if config["routing"] and not named and principal >= 2:
        quota = max(1, config["top_k"] // (2 * principal))
        taken: dict[str, int] = {}
        first = []
        for r in ranked:
            if r["principal"] and taken.get(r["document_id"], 0) < quota:
                taken[r["document_id"]] = taken.get(r["document_id"], 0) + 1
                first.append(r["rowid"])
        chosen = set(first)
        for r in ranked:
            if len(chosen) >= config["top_k"]:
                break
            chosen.add(r["rowid"])
        selected = [r for r in ranked if r["rowid"] in chosen][: config["top_k"]]
    else:
        selected = ranked[: config["top_k"]]
    for r in selected:
        r["selected"] = True
    if config["expand"]:
        by_key = {key(r, r["label"]): r for r in work.values()}
        for _ in range(4):
            groups: dict[tuple, list[dict]] = {}
            for r in selected:
                if r["parent_label"]:
                    groups.setdefault(key(r, r["parent_label"]), []).append(r)
            changed = False
            for k, leaves in groups.items():
                parent = by_key.get(k)
                if parent is None and k in parents:
                    parent = by_key[k] = dict(parents[k], rrf=0.0, rerank=None, selected=False, expanded_to=None, identifier=False, principal=False)
                if parent is None or (len(leaves) < 2 and not parent["selected"]) or (parent["char_count"] or 0) > 3 * config["max_chars"]:
                    continue
                for r in leaves:
                    r["selected"], r["expanded_to"] = False, parent["label"]
                parent["rrf"] = max(parent["rrf"], sum(r["rrf"] for r in leaves))
                scores = [r["rerank"] for r in [*leaves, parent] if r["rerank"] is not None]
                parent["rerank"] = max(scores) if scores else None
                gone = {r["rowid"] for r in leaves}
                selected = [r for r in selected if r["rowid"] not in gone]
                if not parent["selected"]:
                    parent["selected"] = True
                    selected.append(parent)
                work[parent["rowid"]] = parent
                changed = True
            if not changed:
                break
        covered = {key(r, r["label"]) for r in selected}
        for r in ranked:
            if len(selected) >= config["top_k"]:
                break
            if not r["selected"] and r["expanded_to"] is None and not (r["parent_label"] and key(r, r["parent_label"]) in covered):
                r["selected"] = True
                selected.append(r)
    used, context = 0, []
    for r in sorted(selected, key=order):
        size = r["char_count"] or r["chars"]
        if used + size > config["budget"]:
            r["selected"] = False
            continue
        used += size
        context.append(r)
    for place, r in enumerate(sorted(context, key=lambda r: (-(r["precedence"] or 0), *order(r))), 1):
        r["place"] = place
    return [dict(r, place=r.get("place")) for r in work.values()]


#: What ``retrieve`` returns, by name.
RETRIEVED = {"qid": pa.int64(), "rowid": pa.int64(), "rrf": pa.float64(), "bm25_rank": pa.int32(), "dense_rank": pa.int32(), "selected": pa.bool_(), "expanded_to": pa.string(), "place": pa.int32()}


def retrieve(spark: SparkSession, d: str, config: Config | None = None, variants: DataFrame | None = None, rerank: DataFrame | None = None) -> DataFrame:
    """``qid, rowid, rrf, bm25_rank, dense_rank, selected, expanded_to, place``: all candidates of every question; ``place`` is the order in the context.

    ``rerank`` (qid, rowid, score) is the slot of an external reranker: its scores count for the first ``rerank_candidates`` of the fusion.
    Questions whose scope is empty have no rows.
    """
    config = config or Config()
    questions, chunks, scope = questions_of(spark, d), chunks_of(spark, d), scope_of(spark, d)
    blocks, cell = by_blocks(spark, questions), ["workspace_id", "block"]
    vectors = materialize(spark, model_vectors(spark, d), "vectors")
    lists = materialize(spark, search_lists(spark, questions, chunks, scope, vectors, config, variants), "lists")
    if config.prf and config.mode != "dense":
        # the second round searches what the first has not asked yet; both are written, as each is read several times
        terms = feedback(spark, lists.filter("list_no < 2"), questions, chunks, blocks, config.prf_docs, config.prf_terms)
        said = terms.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("terms"))
        more = asked_variants(questions, questions.join(said, "qid").select("qid", F.lit(1000).alias("no"), F.concat("question", F.lit(" "), "terms").alias("text")))
        if variants is not None:
            more = more.join(variants.select("qid", F.trim("text").alias("question")).distinct(), ["qid", "question"], "left_anti").select(more.columns)
        more = materialize(spark, more, "more")
        lists = materialize(spark, lists.unionByName(lexical_lists(spark, more, chunks, scope, config)), "lists")
    rank_of = lambda k: F.min(F.when(F.col("kind") == k, F.col("rank"))).alias(f"{k}_rank")
    # written where the plan would grow: what follows reads it several times
    fused = lists.groupBy("qid", "rowid").agg(rrf_of(config.rrf_k).alias("rrf"), rank_of("bm25"), rank_of("dense"))
    fused = materialize(spark, fused.join(blocks, "qid"), "fused")
    # of the texts only lengths travel, headings and paths only where the section boost reads them
    texts = table(spark, d, "chunks").select("rowid", F.length(F.coalesce("text", F.lit(""))).alias("chars"), *[F.col(c) if config.section_boost else F.lit(None).cast("string").alias(c) for c in ("heading", "section_path")])
    info = scope.join(texts.dropDuplicates(["rowid"]), "rowid").select("rowid", "document_id", "chunk_set_id", "label", "parent_label", "kind", "heading", "section_path", "item_number", "char_count", "chars", "precedence",
                                                                       ((F.col("doc_type") == "edital") & (F.col("doc_kind") == "edital_principal")).alias("principal"))
    info = materialize(spark, info, "info")
    rows = fused.withColumn("identifier", F.lit(False))
    if config.mode == "hybrid":
        # only candidates of questions that name an identifier meet the texts
        ids = questions.select("qid", F.transform(F.array_distinct(F.regexp_extract_all("question", F.lit(IDENTIFIER), 0)), identifier_pattern).alias("patterns")).filter(F.size("patterns") > 0)
        hay = table(spark, d, "chunks").select("rowid", F.concat_ws(" ", F.coalesce("item_number", F.lit("")), "text").alias("hay")).dropDuplicates(["rowid"])
        named_in = fused.select("qid", "rowid").join(ids, "qid").join(hay, "rowid").filter(F.expr("exists(patterns, p -> rlike(hay, p))")).select("qid", "rowid", F.lit(True).alias("identifier")).distinct()
        rows = fused.join(named_in, ["qid", "rowid"], "left").withColumn("identifier", F.coalesce("identifier", F.lit(False)))
    main = table(spark, d, "documents").filter("status = 'ready' and is_current and doc_type = 'edital' and doc_kind = 'edital_principal'").groupBy("workspace_id").agg(F.count("*").cast("int").alias("mains"))
    per = questions.select("qid", "workspace_id").join(main, "workspace_id", "left").select("qid", F.coalesce("mains", F.lit(0)).alias("mains"))
    named = materialize(spark, named_documents(spark, d).groupBy("qid").agg(F.collect_set("document_id").alias("named")), "named")  # the titles a question names
    # what stands above a chunk, up to three levels, chunk by chunk
    above = info.select("document_id", "chunk_set_id", "label", F.col("rowid").alias("up"), F.col("parent_label").alias("next"))
    level = info.filter("parent_label is not null").select("rowid", "document_id", "chunk_set_id", F.col("parent_label").alias("label"))
    pairs = None
    for _ in range(3):
        level = level.join(above, ["document_id", "chunk_set_id", "label"])
        pairs = level.select("rowid", "up") if pairs is None else pairs.unionByName(level.select("rowid", "up"))
        level = level.filter("next is not null").select("rowid", "document_id", "chunk_set_id", F.col("next").alias("label"))
    pairs = materialize(spark, pairs.groupBy("rowid").agg(F.array_sort(F.collect_set("up")).alias("above")), "above")
    # a block of questions meets what is known of its candidates and of what stands above them, each chunk once
    own = [F.col(c).alias(c) for c in cell]  # columns apart from those of the candidates
    met = materialize(spark, fused.select(*cell, "rowid").distinct(), "met")
    higher = met.join(pairs, "rowid").select(*cell, F.explode("above").alias("rowid"))
    known = met.unionByName(higher).distinct().join(info, "rowid").join(pairs, "rowid", "left").select(*own, *info.columns, "above")
    asked = per.join(named, "qid", "left").join(blocks, "qid")
    if rerank is not None:
        scored = rerank.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("rowid", F.col("score").cast("double")))).alias("scores"))
        asked = asked.join(scored, "qid", "left")
    else:
        asked = asked.withColumn("scores", F.lit(None).cast("map<bigint,double>"))
    found = rows.unionByName(asked, allowMissingColumns=True)  # a question's own row has no rowid
    settings = asdict(config)

    def run(_, x: pa.Table, y: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in RETRIEVED}
        about = {r["rowid"]: r for r in y.to_pylist()} if len(x) else {}
        x = x.select(["qid", "rowid", "rrf", "bm25_rank", "dense_rank", "identifier", "mains", "named", "scores"]).sort_by([("qid", "ascending"), ("rowid", "ascending")])
        qids = x.column("qid").to_numpy()
        edges = np.flatnonzero(np.diff(qids, prepend=qids[:1] - 1, append=qids[-1:] + 1))
        for a, b in zip(edges[:-1], edges[1:]):
            one = x.slice(a, b - a).to_pylist()
            rows = [about[r["rowid"]] | {c: r[c] for c in ("rrf", "bm25_rank", "dense_rank", "identifier")} for r in one if r["rowid"] in about]
            if not rows:
                continue
            parents = {(p["document_id"], p["chunk_set_id"], p["label"]): p for r in rows for p in map(about.get, r["above"] or []) if p}
            for q in one:
                if q["rowid"] is not None:
                    continue
                scores = dict(q["scores"]) if q["scores"] else None
                if scores:  # only the first of the fusion are reranked
                    first = sorted(rows, key=lambda r: (-round(r["rrf"], 9), r["rowid"]))[: settings["rerank_candidates"]]
                    scores = {r["rowid"]: scores.get(r["rowid"], float("-inf")) for r in first}
                for r in assemble(rows, parents, set(q["named"] or []), q["mains"], settings, scores):
                    for c in out:
                        out[c].append(q["qid"] if c == "qid" else r.get(c))
        return pa.table({c: pa.array(out[c], type=t) for c, t in RETRIEVED.items()})

    return found.groupBy(*cell).cogroup(known.groupBy(*cell)).applyInArrow(run, "qid bigint, rowid bigint, rrf double, bm25_rank int, dense_rank int, selected boolean, expanded_to string, place int")


@query()
def hybrid_retrieval(spark, d):
    """The context of every question in order."""
    r = retrieve(spark, d).filter("place is not null")
    return r.select("qid", "rowid", F.col("place").alias("rank"), F.round("rrf", 9).alias("rrf"))


@query()
def retrieval_candidates(spark, d):
    """All candidates of every question with section boost and a round of feedback: ranks, score, what they expanded to, and whether the retrieval looks weak."""
    r = retrieve(spark, d, Config(section_boost=True, prf=True))
    weak = F.max(F.col("bm25_rank").isNotNull().cast("int")).over(W.partitionBy("qid")) == 0
    return r.select("qid", "rowid", F.round("rrf", 9).alias("rrf"), "bm25_rank", "dense_rank", "selected", "expanded_to", weak.alias("weak"))


_FEED = f"""s as (select qid, rowid, rank from ranked), fx as (select s.qid, s.rowid, s.rank, {_FW} w from s join (select distinct on (rowid) rowid, text from chunks) c using (rowid)),
 n as (select qid, count(*) n from s group by 1), own as (select qid, {_FW.replace("lower(text)", "lower(question)")} own from q),
 df as (select qid, term, count(*) df from (select distinct qid, rowid, unnest(w) term from fx) group by 1,2),
 sd as (select qid, term, count(*) tf, min((rank, pos)) first_at from (select qid, rank, unnest(w) term, generate_subscripts(w,1) pos from fx where rank<=5) group by 1,2),
 fb as (select sd.qid, sd.term, row_number() over (partition by sd.qid order by round(tf*ln((n+1.0::double)/(df+1)),9) desc, first_at) as place from sd join df using (qid, term) join n on n.qid=sd.qid join own on own.qid=sd.qid where not list_contains(own, sd.term) and n>df qualify place<=8)"""


@query(f"with {_ASKED}, {_BM25}, {_FEED} select qid, term, place from fb")
def question_feedback(spark, d):
    """The feedback terms of each question from its lexical candidates."""
    q, c = questions_of(spark, d), chunks_of(spark, d)
    lists = materialize(spark, bm25(spark, q, c, scope_of(spark, d)).select("qid", F.lit(0).alias("list_no"), "rowid", "rank"), "lists")
    return feedback(spark, lists, q, c, by_blocks(spark, q))


_DENSE = """good as (select chunk_rowid, workspace_id, model_id, embedding, created_at, len(embedding) n from vec0 where chunk_rowid is not null and workspace_id is not null and model_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)))=0 and len(list_filter(embedding, lambda x: x<>0))>0),
 dims as (select model_id, n from (select model_id, n, count(*) c from good group by 1,2) qualify row_number() over (partition by model_id order by c desc, n desc)=1),
 vec as (select chunk_rowid rowid, g.model_id, workspace_id, embedding v from good g join dims using (model_id, n) qualify row_number() over (partition by chunk_rowid, g.model_id order by created_at desc, embedding desc)=1),
 best as (select r.qid, arg_min(r.rowid, r.rank) rowid from ranked r where r.rowid in (select rowid from vec) group by 1), ask as (select best.qid, vec.model_id, vec.workspace_id, vec.v from best join vec using (rowid) where vec.model_id=(select min(model_id) from vec x where x.rowid=best.rowid)),
 ins as (select vec.* from vec where rowid in (select c.rowid from chunks c join documents d on d.document_id=c.document_id where d.status='ready' and d.is_current and c.embed)),
 dense as (select a.qid, i.rowid, row_number() over (partition by a.qid order by round(list_distance(a.v::double[], i.v::double[]),9), i.rowid) as rank from ask a join ins i on i.workspace_id=a.workspace_id and i.model_id=a.model_id qualify rank<=30)"""


@query(f"with {_ASKED}, {_BM25}, {_DENSE}, l as (select qid, rowid, rank from ranked union all select qid, rowid, rank from dense) select qid, rowid, round(sum(1.0::double/(1+rank)),9) as rrf, count(*) as lists from l group by 1,2")
def rank_fusion(spark, d):
    """The lexical and the dense list of every question fused by reciprocal ranks."""
    q, c, scope = questions_of(spark, d), chunks_of(spark, d), scope_of(spark, d)
    lists = materialize(spark, search_lists(spark, q, c, scope, materialize(spark, model_vectors(spark, d), "vectors"), Config()), "lists")
    n = lists.groupBy("qid", "rowid").agg(F.count("*").alias("lists"))
    return rrf(lists).join(n, ["qid", "rowid"]).select("qid", "rowid", F.round("rrf", 9).alias("rrf"), "lists")


_SIZE = "coalesce(nullif(c.char_count,0), length(coalesce(c.text,'')))"


@query(f"""with recursive {_ASKED}, {_BM25}, t as (select r.qid, r.rowid, r.rank, {_SIZE}::bigint size from ranked r join (select distinct on (rowid) * from chunks) c using (rowid) where r.rank<=12),
 f as (select qid, 0::bigint rank, 0::bigint used, null::bigint rowid, false kept from t group by qid union all select t.qid, t.rank, case when f.used+t.size<=5000 then f.used+t.size else f.used end, t.rowid, f.used+t.size<=5000 from f join t on t.qid=f.qid and t.rank=f.rank+1)
 select qid, rowid, row_number() over (partition by qid order by rank) as place, used from f where kept""")
def budget_fit(spark, d):
    """The best twelve lexical candidates of each question that fit 5,000 characters, skipping those that overflow."""
    r = bm25(spark, questions_of(spark, d), chunks_of(spark, d), scope_of(spark, d), 12)
    size = chunks_of(spark, d).select("rowid", F.coalesce(F.nullif("char_count", F.lit(0)), F.length(F.coalesce("text", F.lit("")))).cast("long").alias("size"))
    return fit_budget(r.join(size, "rowid").select("qid", "rowid", F.col("rank").alias("pos"), "size"), 5000)


def fit_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """``qid, rowid, place, used``: rows that fit the budget in the order of ``pos``; one that does not fit is skipped and later ones still tried.

    For the candidates of a question: the rows of one ``qid`` are folded in one array.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "size", "rowid")))
    total = lambda i: F.aggregate(F.slice("rows", 1, i), F.lit(0).cast("bigint"), lambda a, x: F.when(a + x["size"] <= budget, a + x["size"]).otherwise(a))
    marked = ranked.groupBy("qid").agg(rows.alias("rows")).select("qid", F.transform("rows", lambda x, i: F.struct(x["rowid"].alias("rowid"), total(i).alias("before"), x["size"].alias("size"))).alias("m"))
    kept = F.filter("m", lambda x: x["before"] + x["size"] <= budget)
    return marked.select("qid", F.posexplode(kept).alias("p", "x")).select("qid", F.col("x.rowid").alias("rowid"), (F.col("p") + 1).alias("place"), (F.col("x.before") + F.col("x.size")).alias("used"))


@query(f"""with {_ASKED}, {_BM25}, c as (select distinct on (rowid) * from chunks), sel as (select r.qid, c.*, 1.0::double/(1+r.rank) rrf from ranked r join c using (rowid) where r.rank<=12),
 g as (select qid, document_id, chunk_set_id, parent_label, count(*) leaves, sum(rrf) s from sel where parent_label is not null group by all),
 p as (select g.qid, c.rowid parent, g.leaves, g.s, (select max(rrf) from sel where sel.qid=g.qid and sel.rowid=c.rowid) own, {_SIZE} size from g join c on c.document_id=g.document_id and c.chunk_set_id=g.chunk_set_id and c.label=g.parent_label)
 select qid, parent, leaves, round(greatest(coalesce(own,0), s),9) as rrf from p where (leaves>=2 or own is not null) and size<=4800""")
def parent_expansion(spark, d):
    """Parents that take the place of two or more selected leaves, or of one if they are selected themselves; at most three times the chunk limit."""
    r = bm25(spark, questions_of(spark, d), chunks_of(spark, d), scope_of(spark, d), 12).withColumn("rrf", 1.0 / (1 + F.col("rank"))).select("qid", "rowid", "rrf")
    r = materialize(spark, r, "selected")
    c = chunks_of(spark, d)
    leaves = r.join(c.select("rowid", "document_id", "chunk_set_id", F.col("parent_label").alias("label")), "rowid").filter("label is not null")
    g = leaves.groupBy("qid", "document_id", "chunk_set_id", "label").agg(F.count("*").alias("leaves"), F.sum("rrf").alias("s"))
    size = F.coalesce(F.nullif("char_count", F.lit(0)), F.length(F.coalesce("text", F.lit(""))))
    p = g.join(c.select("document_id", "chunk_set_id", "label", F.col("rowid").alias("parent"), size.alias("size")), ["document_id", "chunk_set_id", "label"]).filter("size <= 4800")
    p = p.join(r.select("qid", F.col("rowid").alias("parent"), F.col("rrf").alias("own")), ["qid", "parent"], "left").filter("leaves >= 2 or own is not null")
    return p.select("qid", "parent", "leaves", F.round(F.greatest(F.coalesce("own", F.lit(0.0)), "s"), 9).alias("rrf"))


_COVERS = "(item_number=item or starts_with(item_number, item||'.') or starts_with(item, item_number||'.'))"
_LAB = f"""g as (select distinct row_id qid, trim(expected_item) item from nucleo where trim(expected_item)<>''), hits as (select g.qid, min(r.rank) filter(coalesce({_COVERS}, false)) rank from g join q on q.qid=g.qid left join ranked r on r.qid=g.qid left join (select distinct rowid, item_number from chunks) c on c.rowid=r.rowid group by 1),
 cell as (select k, qid, coalesce(rank<=k, false) hit from hits, (select unnest([5,12,30]) k))"""


def lab_hits(spark, d) -> DataFrame:
    """``qid, rank``: the rank of the first lexical candidate that covers a question's item, null for none."""
    from ..functions.text import item_covers

    q = questions_of(spark, d)
    g = table(spark, d, "nucleo").filter("trim(expected_item) <> ''").select(F.col("row_id").alias("qid"), F.trim("expected_item").alias("item")).distinct().join(q.select("qid"), "qid", "left_semi")
    r = bm25(spark, q, chunks_of(spark, d), scope_of(spark, d)).select("qid", "rowid", "rank").join(chunks_of(spark, d).select("rowid", "item_number"), "rowid")
    return g.join(r, "qid", "left").groupBy("qid").agg(F.min(F.when(item_covers(F.col("item_number"), F.col("item")), F.col("rank"))).alias("rank"))


@query(f"with {_ASKED}, {_BM25}, {_LAB} select 'bm25+k' || k as name, count(*) as questions, round(avg(hit::int),6) as hit from cell group by 1")
def retrieval_lab(spark, d):
    """The share of questions whose item is among the best k, for each k of the grid."""
    grid = spark.createDataFrame([(5,), (12,), (30,)], "k int")  # the grid of configurations, broadcast
    cell = lab_hits(spark, d).join(F.broadcast(grid)).withColumn("hit", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("int"))
    return cell.groupBy(F.concat(F.lit("bm25+k"), "k").alias("name")).agg(F.count("*").alias("questions"), F.round(F.avg("hit"), 6).alias("hit"))


@query(f"""with {_ASKED}, {_BM25}, {_LAB}, x as (select split_part(n.id,'-',2) part, c.k, c.qid, c.hit from cell c join (select row_id, min(id) id from nucleo group by 1) n on n.row_id=c.qid), s as (select k, part, avg(hit::int) r, count(*) filter(not hit) m from x group by 1,2)
 select k, count(*) as samples, round(avg(r),6) as hit, round(min(r),6) as hit_min, round(max(r),6) as hit_max, sum(m)::bigint as misses from s group by 1""")
def retrieval_lab_samples(spark, d):
    """Hits at each k over samples of the questions (the second part of their id): mean, least, most, and the misses."""
    part = table(spark, d, "nucleo").groupBy(F.col("row_id").alias("qid")).agg(F.min("id").alias("id")).select("qid", F.split_part("id", F.lit("-"), F.lit(2)).alias("part"))
    grid = spark.createDataFrame([(5,), (12,), (30,)], "k int")
    cell = lab_hits(spark, d).join(part, "qid").join(F.broadcast(grid)).withColumn("hit", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("int"))
    s = cell.groupBy("k", "part").agg(F.avg("hit").alias("r"), F.sum(1 - F.col("hit")).alias("m"))
    return s.groupBy("k").agg(F.count("*").alias("samples"), F.round(F.avg("r"), 6).alias("hit"), F.round(F.min("r"), 6).alias("hit_min"), F.round(F.max("r"), 6).alias("hit_max"), F.sum("m").alias("misses"))
