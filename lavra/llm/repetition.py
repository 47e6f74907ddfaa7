"""Problem 10: repetition inside one document.

A bounded sample of documents, labelled by the share of their content in repeated
runs, trains boosted trees with monotonic constraints over statistics that are
not that share. In one pass over all documents the flat trees score each from its
statistics; those that may repeat themselves are candidates, and only their share
is counted exactly. The score below which no document is a candidate follows from
the scores of the sample's positive documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .encode import slices
from .gbt import FlatTrees, train
from .sample import bounded_sample

SHARE = 0.35
RUN_WORDS, RUN_CHARS = 8, 20
#: Most documents that are used to fit the trees.
SAMPLE = 4000
#: A document is a candidate from this share of the least odds of a positive document of the sample on, at most these odds.
MARGIN, MOST_ODDS = 0.1, 0.01
FEATURES = ["line_share", "half_share", "seen_ratio", "top_share", "log_units"]
#: More repeated lines, half runs and words seen before never lower the score.
MONOTONE = [1, 1, 1, 0, 0]

_WORD = re.compile(r"[^\W\d_]+")
_MARKED = regex.compile(r"[\p{L}\p{M}]+")
#: Combining marks and scripts that use them, where \w would cut words.
_MARKS = re.compile("[̀-ͯ҃-҉֑-ׇؐ-ًؚ-ٟۖ-ۭऀ-᳿⃐-⃿ꦀ-꯿]")
_FORMAT = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_DENSE = re.compile("[฀-๿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")
_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def text_units(text: str | None) -> tuple[bool, list[str] | str]:
    """Whether the text counts by characters (Chinese, Japanese, Thai), and its words or characters.

    Case, digits, blanks, punctuation and invisible format characters do not count.
    """
    if not text:
        return False, []
    if not text.isascii():
        text = _FORMAT.sub("", text) if _FORMAT.search(text) else text
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _DENSE.search(text):
            letters = _NOT_LETTER.sub("", text.lower())
            if 2 * len(_DENSE.findall(letters)) > len(letters):
                return True, letters
        if _MARKS.search(text):
            return False, _MARKED.findall(text.lower())
    return False, _WORD.findall(text.lower())


def repeated(codes: np.ndarray, doc: np.ndarray, run: int) -> np.ndarray:
    """Marks the units that stand in a run of ``run`` units found earlier in the same document."""
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    if len(codes) < run:
        return covered[:-1] > 0
    with np.errstate(over="ignore"):
        c = (codes.astype(np.uint64) + np.uint64(1)) * _BASE
        c = (c ^ (c >> np.uint64(29))) * _MIX
        powers, width, have, total, mult = {1: (c, _BASE)}, 1, 0, None, None
        while 2 * width <= run:
            h, b = powers[width]
            powers[2 * width] = (h[: len(h) - width] * b + h[width:], b * b)
            width *= 2
        for width in sorted(powers, reverse=True):
            while have + width <= run:
                h, b = powers[width]
                total = h if total is None else total[: len(codes) - have - width + 1] * b + h[have:]
                have += width
        n = len(codes) - run + 1
        key = total[:n] ^ ((doc[:n].astype(np.uint64) + np.uint64(1)) * _MIX)
    whole = np.flatnonzero(doc[:n] == doc[run - 1 :])
    order = whole[np.argsort(key[whole], kind="stable")]
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    covered += np.bincount(again, minlength=len(covered))
    covered -= np.bincount(again + run, minlength=len(covered))[: len(covered)]
    return np.cumsum(covered)[:-1] > 0


class Parsed:
    """The units of texts as codes, words and characters apart: what statistics and shares are counted on."""

    def __init__(self, texts: list[str | None]):
        self.n = len(texts)
        parsed = [text_units(t) for t in texts]
        self.parts = []
        for dense, run in ((False, RUN_WORDS), (True, RUN_CHARS)):
            which = np.array([i for i, (d, u) in enumerate(parsed) if d == dense and u], dtype=np.int64)
            if not len(which):
                continue
            lens = np.fromiter((len(parsed[i][1]) for i in which), dtype=np.int64, count=len(which))
            vocabulary: defaultdict = defaultdict(count().__next__)
            codes = np.fromiter((c for i in which for c in map(vocabulary.__getitem__, parsed[i][1])), dtype=np.int64, count=int(lens.sum()))
            self.parts.append((run, which, lens, codes, len(vocabulary)))

    def shares(self, wanted: np.ndarray) -> np.ndarray:
        """Share of the units in runs that occurred earlier in the same text, of the texts ``wanted`` marks; elsewhere 0."""
        out = np.zeros(self.n)
        for run, which, lens, codes, _ in self.parts:
            keep = wanted[which]
            if keep.any():
                doc = np.repeat(np.arange(len(which)), lens)[np.repeat(keep, lens)]
                mask = repeated(codes[np.repeat(keep, lens)], doc, run)
                out[which] = np.bincount(doc, mask, len(which)) / lens
        return out


def document_statistics(texts: list[str | None], parsed: Parsed | None = None) -> np.ndarray:
    """A row of FEATURES for each text; zeros where a text has no letters."""
    parsed = parsed or Parsed(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for run, which, lens, codes, size in parsed.parts:
        doc = np.repeat(np.arange(len(which)), lens)
        _, first, times = np.unique(doc * size + codes, return_index=True, return_counts=True)
        top = np.zeros(len(which))
        np.maximum.at(top, doc[first], times)
        out[which, 1] = np.bincount(doc, repeated(codes, doc, run // 2), len(which)) / lens
        out[which, 2] = 1 - np.bincount(doc[first], minlength=len(which)) / lens
        out[which, 3] = top / lens
        out[which, 4] = np.log1p(lens)
    for i, t in enumerate(texts):
        lines = [x.strip().lower() for x in t.split("\n")] if t and "\n" in t else []
        if len(lines) > 1:
            seen: set[str] = set()
            all_chars = again = 0
            for x in lines:
                all_chars += len(x)
                again += len(x) if x in seen else 0
                seen.add(x)
            out[i, 0] = again / max(1, all_chars)
    return out


def repetition_shares(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``share`` and FEATURES of each row; null, empty and letterless texts have zeros.

    ``share`` is the share of units in runs that occurred earlier in the same
    text (the first occurrence does not count), ``line_share`` the share of
    characters in lines that occurred earlier.
    """

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                parsed = Parsed(texts)
                share, x = parsed.shares(np.ones(len(texts), dtype=bool)), document_statistics(texts, parsed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(share), *map(pa.array, x.T.copy())], names=[key, "share", *FEATURES])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, share double, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Detector:
    """Trees and the score from which on a document is a candidate."""

    trees: FlatTrees
    candidate: float


def fit(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Detector:
    """The detector fitted on at most ``sample`` documents, taken by hash of the key and labelled by their share."""
    some = bounded_sample(df.select(key, text), key, sample, 10, [key, text])
    rows = repetition_shares(some, key, text).select("share", *FEATURES).toPandas().to_numpy()
    return fit_detector(rows[:, 1:], rows[:, 0] >= SHARE)


def fit_detector(x: np.ndarray, positive: np.ndarray) -> Detector:
    """Without positive documents in the sample every document is a candidate."""
    trees = train(x, positive.astype(float), MONOTONE)
    if not positive.any() or positive.all():
        return Detector(trees, 0.0)
    p = float(trees.score(x)[positive].min())
    odds = min(MOST_ODDS, MARGIN * p / max(1e-12, 1 - p))
    return Detector(trees, odds / (1 + odds))


def repeating(df: DataFrame, key: str, text: str, detector: Detector) -> DataFrame:
    """``key, score, share`` of the documents whose share is at least SHARE.

    One pass without a shuffle: the score decides whose share is counted. Null,
    empty and letterless texts are not found; repeated rows come out repeatedly.
    """
    shared = df.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        d = shared.value
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                parsed = Parsed(texts)
                score = d.trees.score(document_statistics(texts, parsed))
                share = parsed.shares(score >= d.candidate)
                found = pa.array(np.flatnonzero(share >= SHARE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)).take(found), pa.array(score).take(found), pa.array(share).take(found)], names=[key, "score", "share"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, share double")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeating(docs, "doc_id", "text", fit(docs, "doc_id", "text")).select("doc_id").distinct()


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of repeated content of every document, counted exactly."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition_shares(docs, "doc_id", "text").select("doc_id", F.round("share", 6).alias("share"), F.round("line_share", 6).alias("line_share"))


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares}
ORACLE: dict[str, str] = {}
