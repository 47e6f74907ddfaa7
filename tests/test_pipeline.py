"""The retrieval pipeline: feedback against a plain count, what a second round searches, and what travels."""

import math
import re
from collections import Counter

import pytest

from lavra.functions.text import FEEDBACK_STOP_WORDS
from lavra.plans import pipeline, retrieval

SMALL = "/root/testdata/sf0.001"


def said(text):
    return [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if len(w) >= 4 and not w.isdigit() and w not in FEEDBACK_STOP_WORDS]


def plain_feedback(lists, questions, texts, docs, terms):
    """Terms of each question by place, counted candidate by candidate."""
    out = {}
    for qid, _, question in questions:
        mine = sorted((no, rank, rowid) for q, no, rowid, rank in lists if q == qid)
        sample = list(dict.fromkeys(rowid for *_, rowid in mine))[: pipeline.SAMPLE_OF_CANDIDATES]
        best = [r for r in dict.fromkeys(rowid for _, rank, rowid in mine if rank <= docs) if r in sample]
        tf = Counter(w for r in best for w in said(texts.get(r)))  # keeps the order of first appearance
        df = Counter(w for r in sample for w in set(said(texts.get(r))))
        ranked = sorted((-round(n * math.log((len(sample) + 1) / (df[w] + 1)), 9), i, w) for i, (w, n) in enumerate(tf.items()) if len(sample) > df[w] and w not in said(question))
        out |= {(qid, i + 1): w for i, (*_, w) in enumerate(ranked[:terms])}
    return out


@pytest.mark.parametrize("block", [1, 512])
def test_feedback_equals_a_plain_count(spark, monkeypatch, block):
    monkeypatch.setattr(pipeline, "BLOCK_OF_ASKED", block)
    names = ["prazo", "recurso", "bolsa", "edital", "meta", "projeto", "parcela", "2025", "saldo", "orçamento".replace("ç", "c")]
    # 230 candidates; equal weights, words in all texts, an empty and a missing text, a chunk that is not there
    texts = {i: " ".join(names[(i * k) % len(names)] for k in range(1, 3 + i % 4)) + " contrato" for i in range(230)} | {3: "", 5: None}
    questions = [(1, "w", "Qual o prazo do recurso?"), (2, "w", "E o saldo da parcela"), (3, "v", "nada"), (4, "w", "sem candidatos")]
    lists = [(1, 0, i, i + 1) for i in range(30)] + [(1, 1, (7 * i) % 60, i + 1) for i in range(30)] + [(2, 0, i, i + 1) for i in range(225)] + [(2, 1, 229 - i, i + 1) for i in range(9)] + [(3, 0, 3, 1), (3, 0, 5, 2), (3, 1, 999, 1)]
    q = spark.createDataFrame(questions, "qid bigint, workspace_id string, question string")
    c = spark.createDataFrame(list(texts.items()), "rowid bigint, text string")
    found = pipeline.feedback(spark, spark.createDataFrame(lists, "qid bigint, list_no int, rowid bigint, rank int"), q, c, pipeline.by_blocks(spark, q))
    got = {(r["qid"], r["place"]): r["term"] for r in found.collect()}
    assert got == plain_feedback(lists, questions, texts, 5, 8) and {q for q, _ in got} == {1, 2}


def test_a_second_round_searches_only_what_was_not_asked(spark, monkeypatch):
    asked = []

    def bm25(s, questions, *rest):
        asked.extend((r["qid"]["qid"], r["question"]) for r in questions.collect())
        return retrieval.bm25(s, questions, *rest)

    monkeypatch.setattr(pipeline, "bm25", bm25)
    questions = {r["qid"]: r["question"] for r in retrieval.questions_of(spark, SMALL).collect()}
    rows = pipeline.retrieve(spark, SMALL, pipeline.Config(section_boost=True, prf=True)).collect()
    assert rows and len(asked) == len(set(asked)) and {(q, t) for q, t in questions.items()} < set(asked)
    assert all(t.startswith(questions[q]) for q, t in asked)


def test_candidates_travel_without_the_words_of_their_texts(spark, tmp_path):
    """The words of candidates are counted where these are, not shuffled as rows."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    pipeline.QUERIES["retrieval_candidates"](spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "out"))
    assert written() - before < 14e6  # 28.4 MB where words were rows, 7.0 since
