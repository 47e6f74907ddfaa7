"""Problem 5: noise in text from scanned pages.

Lines are labelled by a hidden Markov model with the states header (a running
line), body (goes on with the paragraph) and break (opens a paragraph, or is
blank). It sees layout features: on how many pages of the document the line recurs
(digits and codes masked, confusable letters folded), whether it stands at the
edge of a page or block, whether it carries the page's number, whether it is long,
and how it opens. Start, transition and emission probabilities are estimated by
expectation-maximisation over all documents.

Body lines are joined to paragraphs, across running lines and pages too. Words
divided by the layout are joined in the form the corpus knows. Misread words are
those for which the corpus has a far more frequent word of the same skeleton, the
form in which confusable characters are equal, and which are no more frequent than
the share of misreadings in the whole corpus explains; so words of another language
that merely look alike stay.

Documents are cut into segments of neighbouring blocks; a segment is one row.
What crosses the border of segments is settled on one row a segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, spread, table

HEADER, BODY, BREAK = 0, 1, 2
#: Values of ``block_index`` that make one segment; lines are labelled by segment.
SEGMENT = 64
#: A line of more characters is long.
LONG_LINE = 120
#: How many times as frequent a word must be as its misreading; for words of two letters; for words with a digit or sign inside.
RATIO, RATIO_SHORT, RATIO_SIGN = 12, 60, 2
#: A misreading is no more frequent than the share of misreadings lets expect, plus so many deviations and so many cases.
DEVIATIONS, CASES = 4.0, 2.0
#: Most rounds of the training, the change of the likelihood (a share) that ends it, and the weight of the first emissions against those counted.
ROUNDS, CONVERGED, PRIOR = 8, 1e-4, 0.5

#: What confusable characters become in a skeleton.
CONFUSABLE = {
    "0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "í": "i", "5": "s", "$": "s", "@": "a", "4": "a", "8": "b", "6": "b", "9": "g", "q": "g",
    "3": "c", "e": "c", "f": "t", "7": "t", "2": "z", "d": "ci", "m": "rri", "n": "ri", "u": "ii", "w": "vv", "h": "ii",
}
_HYPHEN = "-¬­‐‑"
_TOKEN = r"[^\W_]+(?:[@$|!][^\W_]*)*|[@$|][^\W_]+(?:[@$|!][^\W_]*)*"
_WORD = re.compile(rf"(?:{_TOKEN})(?:[-‐‑](?:{_TOKEN}))*")
_WORD_PLAIN_HYPHEN = re.compile(rf"(?:{_TOKEN})(?:-(?:{_TOKEN}))*")
#: Runs that may hold words; those of letters only are words.
_RUN = re.compile(r"[\w@$|!\-‐‑]+")
#: A hyphen and a line break or blanks; a hyphen at the end.
_BROKEN = re.compile(rf"[{_HYPHEN}](?:[ \t\xa0]*\r?\n[ \t\xa0]*|[ \t\xa0]+)")
_OPEN_END = re.compile(rf"[{_HYPHEN}]\s*\Z")
_CODE = re.compile(r"\S*\d\S*[-_]\S+|\S+[-_]\S*\d\S*")
_NUMBER = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")
_PAGE_ONLY = re.compile(r"\W*(?:(?:p[aá]g(?:ina|e|\.)?|p\.|fl\.?|fls\.?|folha|page)\W*)?(?:\d+|[ivxlc]{1,7})(?:\s*(?:/|de|of)\s*\d+)?\W*", re.IGNORECASE)
_ROMAN = re.compile(r"[ivxlc]+", re.IGNORECASE)
#: Lines that look like running text: they begin in lower case or with an item number, or end like a sentence.
_PROSE = re.compile(r"\s*(?:[^\W\d_A-ZÀ-Þ]|\d+(?:\.\d+)+\.?\s).*|.*[.;,:]\s*", re.DOTALL)
_ITEM = re.compile(r"(?:[•▪◦‣●*–—-]\s|\(?\d+(?:\.\d+)+[.)]?\s|\(?(?:\d{1,3}|[ivxlcIVXLC]{1,5}|[A-Za-z])[.)]\s|§)")
_DIGITS = re.compile(r"\d{1,6}")
_ENDS = ".!?:;…。！？"

#: Symbols: recurrence 1, 2, 3 and more; inner line, edge of a block, edge of a page; page number none, within, alone; short, long; how the line opens.
PAGES, EDGES, NUMBERS, LENGTHS, OPENS = 3, 3, 3, 2, 4
#: Going on; behind the end of a sentence; at the head of a block, not in lower case; with an item number or bullet.
ON, AFTER_END, HEAD, ITEM = range(OPENS)
BLANK = PAGES * EDGES * NUMBERS * LENGTHS * OPENS
SYMBOLS = BLANK + 1


#: What a letter becomes in a skeleton; marks and soft hyphens vanish.
_FOLDED = str.maketrans(CONFUSABLE) | dict.fromkeys(range(0x300, 0x370)) | {0xAD: None}
_FOLDED_6 = _FOLDED | {ord("6"): "o"}


def skeletons(word: str) -> list[str]:
    """The word with confusable characters made equal; two forms where a 6 may be a b or an o."""
    flat = word.lower()
    if not flat.isascii():
        # an i with an accent is confused like an i without
        flat = unicodedata.normalize("NFKD", flat)
    out = [flat.translate(_FOLDED)]
    if "6" in flat:
        out.append(flat.translate(_FOLDED_6))
    return out


def line_key(line: str) -> str:
    """What recurs of a running line: codes and numbers masked, misread letters folded."""
    x = line.strip()
    digits = any(map(str.isdigit, x))
    if not digits and _PAGE_ONLY.fullmatch(x):
        return _ROMAN.sub("#", x)
    if digits:
        x = _NUMBER.sub("#", _CODE.sub("¤", x) if "-" in x or "_" in x else x)
    return skeletons(" ".join(x.split()))[0]


def may_recur(line: str) -> bool:
    """Whether a line may be a running line by its look: a page number alone, or no running text."""
    return bool(_PAGE_ONLY.fullmatch(line.strip())) or not _PROSE.fullmatch(line.rstrip())


def symbol(pages: int, edge: int, number: int, long: bool, opens: int) -> int:
    return (((min(max(pages, 1), PAGES) - 1) * EDGES + edge) * NUMBERS + number) * LENGTHS * OPENS + int(long) * OPENS + opens


@dataclass
class Chain:
    """The hidden Markov model: probabilities of the first state, from state to state, and of the symbols."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def initial_chain() -> Chain:
    """Where training begins: each feature on its own."""
    pages = np.array([[0.02, 0.3, 0.68], [0.97, 0.02, 0.01], [0.97, 0.02, 0.01]])
    edge = np.array([[0.005, 0.1, 0.895], [0.55, 0.25, 0.2], [0.1, 0.5, 0.4]])
    number = np.array([[0.15, 0.45, 0.4], [0.96, 0.0397, 0.0003], [0.96, 0.0397, 0.0003]])
    long = np.array([[0.98, 0.02], [0.9, 0.1], [0.9, 0.1]])
    opens = np.array([[0.01, 0.12, 0.77, 0.1], [0.88, 0.11, 0.005, 0.005], [0.0001, 0.05, 0.6, 0.3499]])
    emit = np.einsum("sa,sb,sc,sd,se->sabcde", pages, edge, number, long, opens).reshape(3, BLANK)
    blank = np.array([1e-6, 1e-6, 0.2])
    emit = np.concatenate([emit * (1 - blank)[:, None], blank[:, None]], axis=1)
    return Chain(np.array([0.3, 0.1, 0.6]), np.array([[0.05, 0.25, 0.7], [0.05, 0.75, 0.2], [0.1, 0.6, 0.3]]), emit)


def features_apart(emit: np.ndarray) -> np.ndarray:
    """Emissions of counts, each feature on its own: the product of its shares, so that no rare mixture of features draws a state to itself."""
    total = emit.sum(axis=1)
    n = emit[:, :BLANK].reshape(3, PAGES, EDGES, NUMBERS, LENGTHS, OPENS)
    shares = [n.sum(axis=tuple(k for k in range(1, 6) if k != j)) for j in range(1, 6)]
    shares = [x / x.sum(axis=1, keepdims=True) for x in shares]
    lines = np.einsum("sa,sb,sc,sd,se->sabcde", *shares).reshape(3, BLANK)
    blank = (emit[:, BLANK] / total)[:, None]
    return np.concatenate([lines * (1 - blank), blank], axis=1)


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side, one a column, with their lengths."""
    lens = np.array([len(s) for s in sequences])
    out = np.zeros((int(lens.max(initial=0)), len(sequences)), dtype=np.int64)
    for i, s in enumerate(sequences):
        out[: len(s), i] = s
    return out, lens


def viterbi(sequences: list[np.ndarray], chain: Chain) -> list[np.ndarray]:
    """The most likely states of each sequence, all sequences in step."""
    symbols, lens = _padded(sequences)
    if not symbols.size:
        return [np.zeros(0, dtype=np.int8) for _ in sequences]
    with np.errstate(divide="ignore"):
        start, step, emit = np.log(chain.start), np.log(chain.step), np.log(chain.emit).T
    same = np.broadcast_to(np.arange(3, dtype=np.int8), (len(sequences), 3))
    score = start + emit[symbols[0]]
    back = np.empty((*symbols.shape, 3), dtype=np.int8)
    for t in range(1, len(symbols)):
        moves = score[:, :, None] + step
        on = (t < lens)[:, None]
        back[t] = np.where(on, moves.argmax(axis=1), same)
        score = np.where(on, moves.max(axis=1) + emit[symbols[t]], score)
    state = score.argmax(axis=1).astype(np.int8)
    states = np.empty(symbols.shape, dtype=np.int8)
    for t in range(len(symbols) - 1, -1, -1):
        states[t] = state
        if t:
            state = back[t][np.arange(len(state)), state]
    return [states[:n, i] for i, n in enumerate(lens)]


def expected_counts(sequences: list[np.ndarray], chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected first states, steps and emissions of the sequences (forward-backward), and their log likelihood."""
    sequences = [s for s in sequences if len(s)]
    start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, SYMBOLS))
    if not sequences:
        return start, step, emit, 0.0
    symbols, lens = _padded(sequences)
    seen = chain.emit.T[symbols]  # (line, sequence, state)
    forward, scale = np.empty_like(seen), np.ones(symbols.shape)
    for t in range(len(symbols)):
        a = (chain.start if t == 0 else forward[t - 1] @ chain.step) * seen[t]
        scale[t] = a.sum(axis=1)
        forward[t] = a / scale[t][:, None]
    on = np.arange(len(symbols))[:, None] < lens
    backward = np.ones((len(sequences), 3))
    for t in range(len(symbols) - 1, -1, -1):
        backward[t == lens - 1] = 1.0
        both = forward[t] * backward * on[t][:, None]
        both /= np.maximum(both.sum(axis=1), 1e-300)[:, None]
        np.add.at(emit.T, symbols[t][on[t]], both[on[t]])
        if t == 0:
            start = both.sum(axis=0)
        else:
            behind = seen[t] * backward / scale[t][:, None]
            step += np.einsum("ni,nj,n->ij", forward[t - 1], behind, on[t].astype(float)) * chain.step
            backward = np.where(on[t][:, None], behind @ chain.step.T, backward)
    return start, step, emit, float(np.log(scale)[on].sum())


def train(spark: SparkSession, segments: DataFrame) -> Chain:
    """The chain of all segments: rounds of expectation-maximisation until the likelihood no longer changes.

    The features of a line are independent given its state. The first emissions keep
    a share of the weight (PRIOR), so that the states keep their meaning. A round brings back one row of counts a partition, added up.
    """
    chain, before, first = initial_chain(), None, initial_chain().emit
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(chain)

        def run(batches, shared=shared):
            total = np.zeros(3 + 9 + 3 * SYMBOLS + 1)
            for b in batches:
                start, step, emit, likelihood = expected_counts([np.asarray(s, dtype=np.int64) for s in b.column(0).to_numpy(zero_copy_only=False)], shared.value)
                total += np.concatenate([start, step.ravel(), emit.ravel(), [likelihood]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

        rows = segments.select("symbols").mapInArrow(run, "i bigint, n double").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
        shared.unpersist()
        total = np.zeros(3 + 9 + 3 * SYMBOLS + 1)
        total[rows["i"]] = rows["n"]
        start, step, emit, likelihood = total[:3], total[3:12].reshape(3, 3), total[12:-1].reshape(3, SYMBOLS), total[-1]
        chain = Chain((start + 1) / (start + 1).sum(), (step + 1) / (step + 1).sum(axis=1, keepdims=True), features_apart(emit + (PRIOR * emit.sum(axis=1, keepdims=True) + 1) * first))
        if before is not None and abs(likelihood - before) <= CONVERGED * max(1.0, abs(before)):
            break
        before = likelihood
    return chain


def block_keys(batches):
    """Adds to blocks the recurrence keys of their first and last line, where these may recur by their look."""
    for b in batches:
        firsts, lasts = [], []
        for text in b.column("text").to_pylist():
            lines = text.strip().split("\n") if text else []
            firsts.append(line_key(lines[0]) if lines and lines[0] and may_recur(lines[0]) else None)
            lasts.append(firsts[-1] if len(lines) == 1 else line_key(lines[-1]) if lines and may_recur(lines[-1]) else None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(firsts, type=pa.string()), pa.array(lasts, type=pa.string())], names=[*b.schema.names, "first_key", "last_key"])


def line_symbols(lines: list[str], page: int | None, top: bool, bottom: bool, first_pages: int, last_pages: int) -> list[int]:
    """The observed symbols of the lines of one block."""
    full = [k for k, x in enumerate(lines) if x and not x.isspace()]
    out, ended = [BLANK] * len(lines), True
    for k in full:
        x = lines[k].strip()
        head, tail = k == full[0], k == full[-1]
        c = x[0]
        if not c.isalpha() and _ITEM.match(x) or x[1:2] in ".)" and _ITEM.match(x):
            opens = ITEM
        elif c.islower() or not (head or ended):
            opens = ON
        else:
            opens = HEAD if head else AFTER_END
        ended = x[-1] in _ENDS
        pages, number, edge = 1, 0, 0
        if head or tail:
            edge = 2 if head and top or tail and bottom else 1
            pages = max(first_pages if head else 1, last_pages if tail else 1)  # 1 where the line cannot recur by its look
            if _PAGE_ONLY.fullmatch(x):
                number = 2
            else:
                values = _DIGITS.findall(x)
                if values and (pages >= 2 or page is not None and page in map(int, values) and may_recur(lines[k])) or pages >= 2 and ("/" in x or "|" in x):
                    number = 1
        out[k] = symbol(pages, edge, number, len(x) > LONG_LINE, opens)
    return out


_BLOCK = "struct<block_index:int,block_id:bigint,page:int,text:string,top:boolean,bottom:boolean,first_pages:int,last_pages:int>"


def segmented(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """One row a segment: ``document_id, segment, blocks`` in order and ``symbols`` of all their lines."""
    rows = blocks.filter("document_id is not null and block_index is not null and text is not null").select("document_id", "block_index", "block_id", F.col("page_start").alias("page"), "text")
    rows = spread(spark, rows, "document_id", "block_index").distinct()
    keyed = materialize(spark, rows.mapInArrow(block_keys, "document_id string, block_index int, block_id bigint, page int, text string, first_key string, last_key string"), "blocks")
    both = keyed.select("document_id", "page", F.explode(F.array_distinct(F.array("first_key", "last_key"))).alias("key")).filter("key is not null")
    recur = both.distinct().groupBy("document_id", "key").agg(F.count("*").cast("int").alias("pages")).filter("pages > 1")
    ends = keyed.groupBy("document_id", "page").agg(F.min("block_index").alias("low"), F.max("block_index").alias("high"))
    side = lambda c: recur.select("document_id", F.col("key").alias(f"{c}_key"), F.col("pages").alias(f"{c}_pages"))
    info = keyed.join(side("first"), ["document_id", "first_key"], "left").join(side("last"), ["document_id", "last_key"], "left")
    info = info.withColumn("same_page", F.coalesce("page", F.lit(-1))).join(ends.select("document_id", F.coalesce("page", F.lit(-1)).alias("same_page"), "low", "high"), ["document_id", "same_page"])
    one = F.struct(
        "block_index", "block_id", "page", "text", (F.col("block_index") == F.col("low")).alias("top"), (F.col("block_index") == F.col("high")).alias("bottom"),
        F.coalesce("first_pages", F.lit(1)).alias("first_pages"), F.coalesce("last_pages", F.lit(1)).alias("last_pages"),
    )
    grouped = info.groupBy("document_id", F.floor(F.col("block_index") / SEGMENT).cast("long").alias("segment")).agg(F.array_sort(F.collect_list(one)).alias("blocks"))

    def run(batches):
        for b in batches:
            found = [[s for k in seg for s in line_symbols(k["text"].split("\n"), k["page"], k["top"], k["bottom"], k["first_pages"], k["last_pages"])] for seg in b.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, type=pa.list_(pa.int16()))], names=[*b.schema.names, "symbols"])

    return materialize(spark, grouped.mapInArrow(run, f"document_id string, segment bigint, blocks array<{_BLOCK}>, symbols array<smallint>"), "segments")


def divisions(text: str) -> list[tuple[int, int, str, str]]:
    """Words that a hyphen and a break divide: (start, end, first part, rest), each with its span in the text."""
    out: list[tuple[int, int, str, str]] = []
    for m in _BROKEN.finditer(text):
        at = m.start()
        low = max(text.rfind(c, 0, at) for c in " \n\t") + 1
        left = next((w for w in _WORD_PLAIN_HYPHEN.finditer(text, low, at) if w.end() == at), None)
        rest = _WORD_PLAIN_HYPHEN.match(text, m.end())
        if not left or not rest:
            continue
        if out and left.start() < out[-1][1]:  # divided twice: one word of three parts
            start, _, a, b = out.pop()
            out.append((start, rest.end(), a, b + rest.group()))
        else:
            out.append((left.start(), rest.end(), left.group(), rest.group()))
    return out


def open_end(text: str) -> tuple[int, str] | None:
    """The unfinished word at the end of a text: (start, word)."""
    m = _OPEN_END.search(text)
    if not m:
        return None
    low = max(text.rfind(c, 0, m.start()) for c in " \n\t") + 1
    left = next((w for w in _WORD_PLAIN_HYPHEN.finditer(text, low, m.start()) if w.end() == m.start()), None)
    return (left.start(), left.group()) if left else None


def words_of(text: str) -> list[str]:
    """Words in lower case, hyphens made plain."""
    out = []
    for run in _RUN.findall(text.lower()):
        if run.isalpha():
            out.append(run)
        else:
            out += [w.replace("‐", "-").replace("‑", "-") for w in _WORD.findall(run) if not w.isdigit()]
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return " ".join([*out, text[at:]])


class Segment:
    """What one segment holds once its lines are labelled: running lines, divided words, words, and what crosses its borders."""

    def __init__(self, blocks: list[dict], states: np.ndarray):
        self.running: list[tuple[int, str]] = []
        self.splits: list[tuple[int, str, str]] = []
        self.words: list[tuple[int, str, int]] = []
        #: The first word of the segment's body, if in lower case, and its block; the unfinished word at its end.
        self.head: tuple[int, str] | None = None
        self.open: tuple[int, str] | None = None
        self.body = False
        at, pending = 0, None
        for b in blocks:
            lines = b["text"].split("\n")
            own = states[at : at + len(lines)]
            at += len(lines)
            self.running += [(b["block_id"], x.strip()) for x, s in zip(lines, own) if s == HEADER]
            text = "\n".join(x for x, s in zip(lines, own) if s != HEADER) if (own == HEADER).any() else b["text"]
            if not text or text.isspace():
                continue
            spans = []
            first = _WORD.match(text.lstrip())
            if first and first.group()[0].islower():
                begin = len(text) - len(text.lstrip())
                if pending:
                    self.splits.append((*pending, first.group()))
                    spans.append((begin, begin + first.end()))
                elif not self.body:
                    self.head = (b["block_id"], first.group())
                    spans.append((begin, begin + first.end()))
            self.body = True
            cut = divisions(text)
            if spans and cut and cut[0][0] < spans[0][1]:  # the rest of a divided word is divided itself
                cut = cut[1:]
            self.splits += [(b["block_id"], a, z) for _, _, a, z in cut]
            spans += [(s, e) for s, e, _, _ in cut]
            end = open_end(text)
            pending = (b["block_id"], end[1]) if end else None
            if end:
                spans.append((max(end[0], spans[-1][1] if spans else 0), len(text)))
            self.words += [(b["block_id"], w, n) for w, n in Counter(words_of(without(text, spans) if spans else text)).items()]
        self.open = pending


def _lists(parts: list[list[tuple]], types: list[tuple[str, pa.DataType]]) -> pa.Array:
    """A list column of structs from lists of tuples."""
    flat = [x for p in parts for x in p]
    cols = list(zip(*flat)) if flat else [()] * len(types)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(cols, types)], names=[n for n, _ in types]))


_ID, _TEXT = pa.int64(), pa.string()


def labelled(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """``document_id, segment, states, running, splits, words, head, open, body`` of each segment."""
    shared = spark.sparkContext.broadcast(train(spark, segments))

    def run(batches):
        for b in batches:
            states = viterbi([np.asarray(s, dtype=np.int64) for s in b.column("symbols").to_numpy(zero_copy_only=False)], shared.value)
            found = [Segment(blocks, s) for blocks, s in zip(b.column("blocks").to_pylist(), states)]
            edge = pa.struct([("block_id", _ID), ("w", _TEXT)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("document_id"), b.column("segment"), pa.array([s.tobytes() for s in states], type=pa.binary()),
                    _lists([s.running for s in found], [("block_id", _ID), ("w", _TEXT)]), _lists([s.splits for s in found], [("block_id", _ID), ("a", _TEXT), ("b", _TEXT)]),
                    _lists([s.words for s in found], [("block_id", _ID), ("w", _TEXT), ("n", _ID)]),
                    pa.array([s.head and {"block_id": s.head[0], "w": s.head[1]} for s in found], type=edge), pa.array([s.open and {"block_id": s.open[0], "w": s.open[1]} for s in found], type=edge),
                    pa.array([s.body for s in found]),
                ],
                names=["document_id", "segment", "states", "running", "splits", "words", "head", "open", "body"],
            )

    edge = "struct<block_id:bigint,w:string>"
    out = segments.mapInArrow(run, f"document_id string, segment bigint, states binary, running array<{edge}>, splits array<struct<block_id:bigint,a:string,b:string>>, words array<struct<block_id:bigint,w:string,n:bigint>>, head {edge}, open {edge}, body boolean")
    return materialize(spark, out, "labelled")


@dataclass
class Repairs:
    """What was found, and what it takes to write the repaired text."""

    segments: DataFrame
    labelled: DataFrame
    found: DataFrame  # block_id, defect, word
    misread: DataFrame  # document_id, segment, block_id, w, best
    splits: DataFrame  # document_id, segment, block_id, a, b, form, next_segment (null where the word ends in its own)


def find_repairs(spark: SparkSession, blocks: DataFrame) -> Repairs:
    segments = segmented(spark, blocks)
    lab = labelled(spark, segments)
    # a word left open at the end of a segment ends in the next segment that has a body, if that begins in lower case
    after = Window.partitionBy("document_id").orderBy("segment")
    border = lab.filter("body").select("document_id", "segment", "head", "open", F.lead("head").over(after).alias("next"), F.lead("segment").over(after).alias("next_segment"), F.lag("open").over(after).alias("before"))
    border = materialize(spark, border, "borders")
    inside = lab.select("document_id", "segment", F.explode("splits").alias("s")).select("document_id", "segment", "s.*", F.lit(None).cast("bigint").alias("next_segment"))
    across = border.filter("open is not null and next is not null").select("document_id", "segment", F.col("open.block_id"), F.col("open.w").alias("a"), F.col("next.w").alias("b"), "next_segment")
    parts = materialize(spark, inside.unionByName(across), "splits")
    heads = border.filter("head is not null and before is null").select("document_id", "segment", F.col("head.block_id"), F.lower("head.w").alias("w"), F.lit(1).cast("bigint").alias("n"))
    words = lab.select("document_id", "segment", F.explode("words").alias("s")).select("document_id", "segment", "s.*").unionByName(heads)
    counted = words.groupBy("w").agg(F.sum("n").alias("n"))
    lexicon = materialize(spark, with_skeletons(counted), "lexicon")
    best = best_by_skeleton(lexicon)
    wrong = materialize(spark, misread_types(lexicon, best), "wrong")
    misread = words.join(wrong, "w").select("document_id", "segment", "block_id", "w", "best")
    # the form of a divided word: with or without its hyphen, as the corpus knows it
    known = lexicon.select("w", "n").distinct()
    pairs = parts.select(F.lower(F.concat("a", "b")).alias("w"), F.lower(F.concat("a", F.lit("-"), "b")).alias("alt")).distinct()
    pairs = pairs.join(known.select("w", F.col("n").alias("n_w")), "w", "left").join(known.select(F.col("w").alias("alt"), F.col("n").alias("n_alt")), "alt", "left")
    n_w, n_alt = F.coalesce("n_w", F.lit(0)), F.coalesce("n_alt", F.lit(0))
    chosen = pairs.select("w", "alt", F.when(n_alt > n_w, F.col("alt")).otherwise(F.col("w")).alias("form"), F.greatest(n_w, n_alt).alias("n"))
    # a divided word that is misread as well: either form may have a frequent word of its skeleton
    doubtful = with_skeletons(chosen.filter(F.col("n") < RATIO).select("form", "n", F.explode(F.array_distinct(F.array("w", "alt"))).alias("w")))
    fixed = doubtful.join(best, "skeleton").filter(F.col("best_n") >= RATIO_SIGN * F.greatest(F.col("n"), F.lit(1)) * 2).groupBy("form").agg(F.max(F.struct("best_n", "best")).alias("m")).select("form", F.col("m.best").alias("best"))
    forms = materialize(spark, chosen.join(fixed, "form", "left").select("w", "alt", "form", F.coalesce("best", "form").alias("best")), "forms")
    splits = parts.withColumn("w", F.lower(F.concat("a", "b"))).withColumn("alt", F.lower(F.concat("a", F.lit("-"), "b"))).join(forms, ["w", "alt"])
    row = lambda kind, word: [F.col("block_id"), F.lit(kind).alias("defect"), F.col(word).alias("word")]
    running = lab.select(F.explode("running").alias("s")).select(F.col("s.block_id"), F.lit("running").alias("defect"), F.col("s.w").alias("word"))
    found = running.unionByName(splits.select(*row("split", "best"))).unionByName(misread.select(*row("misread", "best"))).unionByName(splits.filter("best <> form").select(*row("misread", "best")))
    return Repairs(segments, lab, found.distinct(), misread, splits.select("document_id", "segment", "block_id", "a", "b", F.col("best").alias("form"), "next_segment"))


def repairs(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """``block_id, defect, word`` for running lines, divided and misread words.

    Null and blank texts have no defects, nor have blocks without document or
    place. Repeated rows count once. Ties between words of one skeleton go to the
    more frequent, then the smaller. An empty table gives no rows. Other columns
    are not read.
    """
    return find_repairs(spark, blocks).found


def with_skeletons(words: DataFrame) -> DataFrame:
    """One row for each skeleton of ``w``."""
    names = words.columns

    def run(batches):
        for b in batches:
            forms = [skeletons(w) for w in b.column("w").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(forms)), [len(f) for f in forms]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in names), pa.array([x for f in forms for x in f], type=pa.string())], names=[*names, "skeleton"])

    return words.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", skeleton string")


def best_by_skeleton(lexicon: DataFrame) -> DataFrame:
    """The most frequent word of each skeleton, only letters and hyphens."""
    plain = lexicon.filter(F.col("w").rlike(r"^[\p{L}\p{M}-]+$"))
    return plain.groupBy("skeleton").agg(F.max(F.struct("n", (-F.ascii("w")).alias("a"), "w")).alias("m")).select("skeleton", F.col("m.w").alias("best"), F.col("m.n").alias("best_n"))


def misread_types(lexicon: DataFrame, best: DataFrame) -> DataFrame:
    """``w, best`` of the words that are misreadings.

    The share of misreadings is that of all words which their ratio alone makes
    suspect. A word of letters that occurs more often than this share of the best
    word's count allows is a word of its own.
    """
    sign = F.col("w").rlike(r"[^\p{L}\p{M}-]")
    size = F.length("w")
    ratio = F.when(sign & (size > 2), RATIO_SIGN).when(size <= 2, RATIO_SHORT).otherwise(RATIO)
    pairs = lexicon.join(best, "skeleton").filter((F.col("best") != F.col("w")) & (F.length("w") > 1) & (F.col("best_n") >= ratio * F.col("n"))).withColumn("sign", sign)
    suspect = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad"))
    share = lexicon.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1)).alias("all")).join(suspect).select((F.col("bad") / F.col("all")).alias("share"))
    expected = F.col("share") * F.col("best_n")
    kept = pairs.join(F.broadcast(share)).filter(F.col("sign") | (F.col("n") <= expected + DEVIATIONS * F.sqrt(expected) + CASES))  # one row
    return kept.groupBy("w").agg(F.max(F.struct("best_n", "best")).alias("m")).select("w", F.col("m.best").alias("best"))


def cased(form: str, like: str) -> str:
    """``form`` in the case of what it replaces: all capitals, a capital first, or lower case."""
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return form.upper()
    return form[:1].upper() + form[1:] if letters and letters[0].isupper() else form


def repaired(text: str, words: dict[str, str], splits: dict[tuple[str, str], str], drop: str | None, tail: tuple[str, str] | None) -> str:
    """The text of a block's body with its words joined and corrected.

    ``drop`` is the rest of a word that began in an earlier block; ``tail`` the
    unfinished word at the end and what the whole word is.
    """
    pieces, at = [], 0
    if drop:
        at = len(text) - len(text.lstrip("\1 \t\n\r"))
        at = at + len(drop) if text[at:].startswith(drop) else 0
    stop, end = len(text), ""
    if tail and (o := open_end(text)) and o[1] == tail[0]:
        stop, end = o[0], cased(tail[1], tail[0])
    for s, e, a, b in divisions(text):
        if s >= at and e <= stop:
            pieces += [text[at:s], "\0" + cased(splits.get((a, b), a + b), a)]
            at = e
    pieces.append(text[at:stop])

    def correct(m: re.Match) -> str:
        best = words.get(m.group().lower().replace("‐", "-").replace("‑", "-"))
        return cased(best, m.group()) if best else m.group()

    return "".join(p[1:] if p.startswith("\0") else _WORD.sub(correct, p) if words else p for p in pieces) + end


def segment_paragraphs(blocks: list[dict], states: np.ndarray, words: dict, splits: dict, drops: dict) -> tuple[list[tuple[int, list[int], str]], int]:
    """The pieces of paragraphs of a segment, (paragraph, block ids, text) counted from its first break, and the number of breaks.

    Piece 0 is what goes on with the paragraph before the segment.
    """
    out: list[tuple[int, list[int], list[str]]] = []
    at, number, drop, blank = 0, 0, drops.get("head"), False
    for b in blocks:
        lines = b["text"].split("\n")
        own = states[at : at + len(lines)]
        at += len(lines)
        body = [(x, s) for x, s in zip(lines, own) if s != HEADER]
        if not any(x.strip() for x, _ in body):
            blank = blank or bool(body)
            continue
        tail = drops.get(b["block_id"])
        text = repaired("\n".join(("\1" if s == BREAK else "") + x for x, s in body), words.get(b["block_id"], {}), splits.get(b["block_id"], {}), drop, tail[:2] if tail else None)
        opens = 0
        for line in text.split("\n"):
            opens = opens or line.count("\1")
            x = " ".join(line.replace("\1", "").split())
            if not x:
                continue
            # behind an empty line a paragraph begins, but for a line that goes on in lower case, as under a running line
            if opens or blank and not x[0].islower():
                number += 1
                out.append((number, [], []))
            elif not out:
                out.append((number, [], []))
            opens, blank = 0, False
            if not out[-1][1] or out[-1][1][-1] != b["block_id"]:
                out[-1][1].append(b["block_id"])
            out[-1][2].append(x)
        blank = blank or bool(opens)
        drop = tail[2] if tail and len(tail) > 2 else None
    return [(n, ids, " ".join(x)) for n, ids, x in out], number


def paragraphs(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """``document_id, paragraph, first_block, last_block, text``: the repaired text, paragraphs counted from 1.

    Running lines are left out, divided words joined, misread words corrected;
    a paragraph goes on across blocks and pages. Null and blank texts have no
    paragraph. Repeated rows count once; an empty table gives no rows.
    """
    r = find_repairs(spark, blocks)
    on = ["document_id", "segment"]
    fix = r.misread.groupBy(*on).agg(F.collect_list(F.struct("block_id", "w", "best")).alias("fix"))
    join_ = r.splits.groupBy(*on).agg(F.collect_list(F.struct("block_id", "a", "b", "form", F.col("next_segment").isNotNull().alias("crosses"))).alias("join"))
    heads = r.splits.filter("next_segment is not null").groupBy("document_id", F.col("next_segment").alias("segment")).agg(F.min("b").alias("head_drop"))
    rows = r.segments.select(*on, "blocks").join(r.labelled.select(*on, "states"), on).join(fix, on, "left").join(join_, on, "left").join(heads, on, "left")

    def run(batches):
        for b in batches:
            t = {c: b.column(c).to_pylist() for c in b.schema.names}
            pieces, breaks = [], []
            for bl, st, fx, jn, hd in zip(t["blocks"], t["states"], t["fix"], t["join"], t["head_drop"]):
                words: dict = {}
                for x in fx or []:
                    words.setdefault(x["block_id"], {})[x["w"]] = x["best"]
                splits: dict = {}
                drops: dict = {"head": hd}
                for x in jn or []:
                    splits.setdefault(x["block_id"], {})[x["a"], x["b"]] = x["form"]
                    text = next((k["text"] for k in bl if k["block_id"] == x["block_id"]), "")
                    if x["crosses"] or not any((a, z) == (x["a"], x["b"]) for _, _, a, z in divisions(text)):
                        drops[x["block_id"]] = (x["a"], x["form"]) + (() if x["crosses"] else (x["b"],))
                p, n = segment_paragraphs(bl, np.frombuffer(st, dtype=np.int8), words, splits, drops)
                pieces.append([(k, ids[0], ids[-1], x) for k, ids, x in p])
                breaks.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("document_id"), b.column("segment"), _lists(pieces, [("p", _ID), ("first_block", _ID), ("last_block", _ID), ("text", _TEXT)]), pa.array(breaks, type=_ID)], names=["document_id", "segment", "pieces", "breaks"])

    piece = "struct<p:bigint,first_block:bigint,last_block:bigint,text:string>"
    done = materialize(spark, rows.mapInArrow(run, f"document_id string, segment bigint, pieces array<{piece}>, breaks bigint"), "pieces")
    # one row a segment: how many paragraphs began before it; a piece 0 with none before it is the first paragraph
    w = Window.partitionBy("document_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = done.select(*on, F.coalesce(F.sum("breaks").over(w), F.lit(0)).alias("offset"))
    parts = done.join(offsets, on).select("document_id", "segment", "offset", F.explode("pieces").alias("x")).select("document_id", "segment", (F.col("offset") + F.col("x.p")).alias("n"), "x.first_block", "x.last_block", "x.text")
    whole = parts.groupBy("document_id", "n").agg(F.array_sort(F.collect_list(F.struct("segment", "first_block", "last_block", "text"))).alias("x"))
    first = whole.groupBy("document_id").agg(F.min("n").alias("least"))
    return whole.join(first, "document_id").select(
        "document_id", (F.col("n") - F.col("least") + 1).cast("int").alias("paragraph"), F.col("x")[0]["first_block"].alias("first_block"),
        F.element_at("x", -1)["last_block"].alias("last_block"), F.array_join(F.transform("x", lambda p: p["text"]), " ").alias("text"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(spark, table(spark, sf_dir, "blocks"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, table(spark, sf_dir, "blocks"))


def p5_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by kind: rows, blocks and distinct words."""
    return p5_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("found"), F.countDistinct("block_id").alias("blocks"), F.countDistinct("word").alias("words"))


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p5_defects": p5_defects}
ORACLE: dict[str, str] = {}
