"""The queries that leave nothing out, against brute force."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from lavra.functions.text import FEEDBACK_STOP_WORDS
from lavra.operators import answers
from lavra.plans import pipeline, retrieval, texts

DATA = "/root/testdata/sf0.01"
#: rowid, document_id, text: Latin with U+2019, other scripts alone and mixed, marks, a repeated row, blank and null.
TEXTS = [
    (1, "a", "O prazo d’água é de prazo único"), (2, "a", "Приложение к договору, приложение ёлка"), (3, "a", "预算 表格 contrapartida 预算执行情况"), (4, "a", "ガイド がいど 予算"),
    (5, "b", "ข้อกำหนด ทุนวิจัย"), (6, "b", "الميزانيّة السنويّة ٢٠٢٥"), (7, "b", "Ωμέγα ΩΜΕΓΑ ωμεγα"), (8, "b", "예산 문서 예산"), (8, "b", "예산 문서 예산"), (9, "c", "हिन्दी परियोजना योजना"), (10, "c", ""), (11, "c", None),
]


def tokens(text):
    """Lower case without marks, cut at all that is no letter and no digit; what does not lose a mark stays composed."""
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.category(c).startswith("M"))
    out, word = [], ""
    for c in unicodedata.normalize("NFC", plain) + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def chunk_texts(spark, d):
    return {(r["rowid"], r["document_id"], r["text"]) for r in spark.read.parquet(f"{d}/chunks.parquet").select("rowid", "document_id", "text").collect()}


@pytest.fixture(scope="module")
def scripts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("scripts"))
    kinds = "rowid bigint, document_id string, text string, workspace_id string, chunk_set_id string, label string, parent_label string, kind string, item_number string, context_prefix string, char_count int, embed boolean"
    spark.createDataFrame([(r, doc, t, "w", "s", None, None, "item", None, None, None, True) for r, doc, t in TEXTS], kinds).write.parquet(f"{d}/chunks.parquet")
    return d


@pytest.mark.parametrize("data", ["fixture", DATA])
def test_lexicon_counts_every_script(spark, scripts, data):
    d = scripts if data == "fixture" else data
    df, tf = Counter(), Counter()
    for _, _, t in chunk_texts(spark, d):
        n = Counter(tokens(t))
        df.update(n.keys())
        tf.update(n)
    got = {unicodedata.normalize("NFC", r["token"]): (r["df"], r["tf"]) for r in texts.QUERIES["lexicon"](spark, d).collect()}
    assert got == {w: (df[w], tf[w]) for w in df}


@pytest.mark.parametrize("data", ["fixture", DATA])
def test_feedback_terms_rank_every_script(spark, scripts, data):
    d = scripts if data == "fixture" else data
    docs = defaultdict(list)
    for _, doc, t in sorted(chunk_texts(spark, d), key=str):
        if t is not None:
            docs[doc].append(Counter(w for w in tokens(t) if len(w) >= 4 and not re.fullmatch(r"[0-9]+", w) and w not in FEEDBACK_STOP_WORDS))
    want = set()
    for doc, counts in docs.items():
        tf, df = sum(counts, Counter()), Counter(w for c in counts for w in c)
        ranked = sorted((-round(tf[w] * math.log((len(counts) + 1) / (df[w] + 1)), 6), w) for w in tf if len(counts) > df[w])
        want |= {(doc, w, -x) for x, w in ranked[:8]}
    assert {(r["document_id"], r["term"], r["weight"]) for r in retrieval.QUERIES["feedback_terms"](spark, d).collect()} == want


def known_workspaces(spark, d):
    """What each workspace is called by; a call code goes before a name, a name before an id, and the last id wins."""
    keys = {}
    w = sorted(spark.read.parquet(f"{d}/workspaces.parquet").collect(), key=lambda r: r["id"])
    for field in ("id", "name", "call_code"):
        keys |= {r[field]: r["id"] for r in w if r[field] is not None}
    return keys


def test_questions_name_their_workspace_by_any_key(spark):
    keys = known_workspaces(spark, DATA)
    asked = {(r["row_id"], r["workspace"]) for r in spark.read.parquet(f"{DATA}/nucleo.parquet").filter("question is not null").select("row_id", "workspace").collect()}
    want = {(row, keys[w]) for row, w in asked if w in keys}
    by_code = {r["call_code"] for r in spark.read.parquet(f"{DATA}/workspaces.parquet").collect()}
    assert any(w not in by_code for _, w in asked if w in keys)
    assert {(r["qid"], r["workspace_id"]) for r in retrieval.questions_of(spark, DATA).collect()} == want


def test_grounding_context_of_every_question(spark):
    keys = known_workspaces(spark, DATA)
    chunks = defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/chunks.parquet").filter("item_number is not null").select("rowid", "workspace_id", "item_number").collect():
        chunks[r["workspace_id"]].add((r["rowid"], r["item_number"]))
    want = set()
    for r in spark.read.parquet(f"{DATA}/nucleo.parquet").filter("expected_item <> ''").select("row_id", "workspace", "expected_item").collect():
        x = r["expected_item"]
        want |= {(r["row_id"], rowid) for rowid, i in chunks[keys.get(r["workspace"])] if i == x or i.startswith(x + ".") or x.startswith(i + ".")}
    assert {(r["row_id"], r["rowid"]) for r in texts.QUERIES["expected_item_chunks"](spark, DATA).collect()} == want
    _, context = answers._answers(spark, DATA)
    assert {r["aid"] for r in context.select("aid").distinct().collect()} == {row for row, _ in want}


def test_dense_list_is_cut_to_the_scope_before_the_search(spark):
    # question 1: its best hit has no vector; 40 nearer vectors are out of scope, one of a chunk that is not embedded
    vectors = [(10, "w", [0.0, 1.0])] + [(100 + i, "w", [0.0, 1.0 + i / 1000]) for i in range(40)] + [(200 + i, "w", [1.0, 1.0 + i]) for i in range(35)] + [(300, "w", [0.0, 1.0])]
    vectors = spark.createDataFrame([(r, w, "m", v) for r, w, v in vectors], "rowid bigint, workspace_id string, model_id string, v array<float>")
    scope = spark.createDataFrame([(10, True), (9, True), (300, False)] + [(200 + i, True) for i in range(35)], "rowid bigint, embed boolean")
    lists = spark.createDataFrame([(1, 9, 1), (1, 10, 2), (2, 9, 1)], "qid bigint, rowid bigint, rank int")
    got = sorted((r["rank"], r["qid"], r["rowid"]) for r in pipeline.dense_lists(spark, lists, vectors, scope).collect())
    assert got == [(1, 1, 10)] + [(i + 2, 1, 200 + i) for i in range(29)]


def test_knn_search_covers_every_model(spark):
    spaces = defaultdict(dict)
    rows = {(r["chunk_rowid"], r["workspace_id"], r["model_id"], tuple(r["embedding"])) for r in spark.read.parquet(f"{DATA}/vec0.parquet").filter("embedding is not null").collect()}
    length = {"m-base": 96, "m-mini": 64}
    for rowid, w, model, v in rows:
        if len(v) == length[model] and all(x is not None and math.isfinite(x) for x in v) and any(v):
            spaces[w, model][rowid] = np.array(v, dtype=np.float64)
    want = {}
    for (_, model), vs in spaces.items():
        for qid in (r for r in vs if r % 20 == 0):
            near = sorted((round(float(np.sqrt(((v - vs[qid]) ** 2).sum())), 9), rowid) for rowid, v in vs.items())[:10]
            want |= {(qid, model, i + 1, rowid): x for i, (x, rowid) in enumerate(near)}
    assert {m for _, m, *_ in want} == {"m-base", "m-mini"}
    got = {(r["qid"], r["model_id"], r["rank"], r["rowid"]): r["dist"] for r in retrieval.QUERIES["knn_search"](spark, DATA).collect()}
    assert got == pytest.approx(want, abs=1e-5)
