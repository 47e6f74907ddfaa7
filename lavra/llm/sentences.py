"""Problem 1: sentence boundaries across languages and scripts.

A hidden-event n-gram model: in every gap of a line, between any two words and between
any two letters of a script without spaces, stands a hidden event, boundary or none. A gap
has the log odds of the kind of gap it is (its mark, what closes it, how the next word opens,
whether a quotation holds it; without a mark, whether its text has marks at all), of what
stands before it and of what stands after it. Without a boundary the next word depends on
the one before it (a bigram with absolute discounting of one, so that no gap speaks for itself); behind a boundary it does
not. What ends and begins lines teaches which words end and begin sentences;
expectation-maximisation over the gaps within lines teaches which words stand where no
boundary is, and how often each kind of gap is a boundary. Forward-backward posteriors
along each line, over the sentences between boundaries, decide, with the learnt odds of
sentences of almost no length. No odds are set by hand.

Counts are those of all texts: words are hashed into buckets and summed on the
executors, and rounds of training run over the distinct gaps, not over texts. Gaps without
a mark in a text that has marks are boundaries at first as often as lines of several
sentences end without one. A text without any mark is scored by what ends and begins the
lines of such texts.

Fixed by definition are: the end of a line is a boundary; a blank between Thai
letters is one; there is none after commas, colons and semicolons, nor within
quotations and brackets, nor within a cluster of letters and their signs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from .encode import slices

#: Buckets of words and of their shapes.
BUCKETS, SHAPES = 1 << 18, 6 * 256
#: Buckets in a hash row of what the bigrams count; a count is the least of its rows. Gaps with and without a mark have their own.
NGRAMS, ROWS = 1 << 20, 2
#: Rounds of training. Marks of which few stand at line ends lose their boundaries in further rounds.
ROUNDS = 2
#: First rounds, in which the ends and starts of lines alone teach what boundaries look like; then expected boundaries within lines do too.
LINES_ALONE = 1
#: Weight of a word's shape against its own count.
BACKOFF = 5.0
#: Weight of a word's frequency without a mark, which counts besides its frequency at line ends.
PLAIN = 0.5
#: A sentence of fewer letters has almost no length.
SHORT = 6
#: Share of boundaries of a kind of gap before training: with a mark; with one before lower case or within what a sentence holds. Weight of these shares against the counts.
UNSEEN_YES, UNSEEN_NO, PRIOR = 0.9, 0.05, 0.2
#: Words that a text without any mark must have to teach how such texts divide.
BARE_WORDS = 100
#: A gap without a mark and of lower log odds stays out of forward-backward: it would change the odds of the others by less than a part in 20,000.
FLOOR = -10.0
#: Pairs of words whose odds a process keeps.
KEPT = 1 << 18

_DENSE = "฀-๿຀-໿က-႟ក-៿぀-ヿ㇀-㋿㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_CLOSE = "\"”’»)\\]」』）】〉》›＂'"
_WIDE = "。！？｡．।॥؟۔።။៕។"
_BREAKS = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
_CANDIDATE = re.compile(rf"([.!?…‼⁇⁈⁉]+|[{_WIDE}]+[.!?…{_WIDE}]*)([{_CLOSE}]*)(\s*)(?=\S)")
_ANY_MARK = re.compile(rf"[.!?…‼⁇⁈⁉{_WIDE}]")
_OPEN = "“«「『（(【《\"„¿¡‘'["
_CLOSERS = "\"”’»)]」』）】〉》›＂'"
#: What opens or closes and does nothing else.
_OPEN_ONLY, _CLOSE_ONLY = "“«「『（(【《„¿¡‘[", ")]}»”」』）】》"
_OPENERS = re.compile(r"[“«「『（(【《\"„]")
_PAIR = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|\([^()]*\)|（[^（）]*）|【[^】]*】|《[^》]*》|\"[^\"]*\"")
_THAI = re.compile("[฀-๿]")
#: Letters of other scripts that put no blanks between words: Lao, Khmer, Myanmar.
_SPACELESS = re.compile("[\u0e80-\u0eff\u1780-\u17d3\u1000-\u1049]")
_SPACELESS_GAP = re.compile("(?<=[\u0e00-\u0eff\u1780-\u17d3\u1000-\u1049])[^\\S\n\r\v\f\x1c-\x1e\x85\u2028\u2029]+(?=[\u0e00-\u0eff\u1780-\u17d3\u1000-\u1049])")
#: Vowels written before their consonant, signs that join the next letter to theirs.
_LEADS = "เแโใไເແໂໃໄ\u17d2\u1039"
_WORD = re.compile(r"\S+")
_NO_END = ",;:，；：、،؛"
#: What opens a line before its sentence: bullets, numbers, letters and their marks.
_PREFIX = re.compile(
    r"\s*(?:[•▪◦·*‣●–—-]\s+)?"
    r"(?:\(?\d+(?:\.\d+)+[.)º°]*(?:\s+[-–—])?\s+|\(?\d+(?:[.)º°]+\s+|\s+[-–—]\s+|\s+(?=[A-ZÀ-Þ]))|\(?(?:[IVXLCDM]{1,6}|[A-Za-z])(?:[.)]+|\s+[-–—])\s+)?"
)
_EDGE = re.compile(r"^[\W_]+", re.UNICODE)
_NEXT = re.compile(r"[^\W\d_][\ẁ-ͯऀ-ॿؐ-ًؚ-ٟ'’-]*|\d+|\S")
_DENSE_CHAR = re.compile(f"[{_DENSE}]")
_DENSE_RUN = re.compile(f"[{_DENSE}]{{2,}}")
_DIGITS = re.compile(r"\d+")
_OTHER_BLANKS = "\t\xa0\u2002\u2003\u2009\u202f\u3000"
_AFTER_NUMBER = re.compile(r"[\d.,/]*(\s?(?:[a-zà-ÿ]{1,12}|\S)|)")


def lines_of(text: str) -> list[tuple[int, str]]:
    """Start and text of each line that is not empty."""
    out, at = [], 0
    for full in text.splitlines(True):
        if line := full.rstrip(_BREAKS):
            out.append((at, line))
        at += len(full)
    return out


def word_start(line: str, end: int) -> int:
    """Where the run without blanks begins that ends at ``end``."""
    at = line.rfind(" ", 0, end) + 1
    for c in _OTHER_BLANKS:
        if c in line:
            at = max(at, line.rfind(c, 0, end) + 1)
    return at


def before(line: str, end: int) -> str:
    """The token before a mark: the word, with the one before it where it is short."""
    at = word_start(line, end)
    w = line[at:end]
    if w and not w.isascii():
        if _DENSE_CHAR.match(w[-1]):
            return w[-2:]
        dense = max((m.end() for m in _DENSE_CHAR.finditer(w)), default=0)
        at, w = at + dense, w[dense:]
    short = w if w.isalpha() else _DIGITS.sub("9", _EDGE.sub("", w).rstrip("\"”’»)]"))
    if len(short) <= 2 and w:
        head = line[:at].rstrip()
        if head and _DENSE_CHAR.match(head[-1]):
            return head[-2:] + " " + short
        short = (_DIGITS.sub("9", head[word_start(head, len(head)) :]) if head else "^") + " " + short
    return short


def opened(line: str, start: int) -> int:
    """Where the first word begins behind opening quotes, brackets and marks."""
    at = start
    while at < len(line) and line[at] in _OPEN:
        at += 1
    return at if at < len(line) and not line[at].isspace() else start


def after(line: str, start: int) -> str:
    start = opened(line, start)
    m = _NEXT.match(line, start)
    w = m.group() if m else ""
    if w and _DENSE_CHAR.match(w[0]):
        return line[start : start + 3]
    if w[:1].isdigit():
        return "9" + _AFTER_NUMBER.match(line, start)[1].lower()
    return w + ("." if len(w) == 1 and line[start + 1 : start + 2] == "." else "")


def shape(w: str) -> str:
    """The class a rare token falls back to."""
    x = w.rsplit(" ", 1)[-1]
    if not x:
        return "-"
    kind = follower_kind(x[0])
    kind = x[0] if kind == "o" else kind
    size = "1" if len(x) == 1 else "3" if len(x) <= 3 else "+"
    return kind + size + ("." if "." in x[:-1] else "")


#: How a word opens: lower case, upper case, digit, letter of a script without spaces, other letter, other.
OPENS = "lu9dxo"


def follower_kind(c: str) -> str:
    return "l" if c.islower() else "u" if c.isupper() else "9" if c.isdigit() else "d" if _DENSE_CHAR.match(c) else "x" if c.isalpha() else "o"


@lru_cache(1 << 17)
def hashed(w: str) -> tuple[int, int]:
    """Bucket of a token, and of its shape: 256 for each way to open."""
    x = shape(w)
    kind = OPENS.find(x[0]) if x[0] in "lu9dx" else 5
    return crc32(w.encode("utf-8", "replace")) % BUCKETS, kind * 256 + crc32(x.encode("utf-8", "replace")) % 256


#: Tables of words: at gaps with a mark, without one in texts that have none, without one in texts with marks.
TABLES = 3
#: Kinds of gaps without a mark: between words and between letters of a text without any mark, the same in other texts, a blank between letters of a script without spaces in both.
BARE, BARE_LETTERS, PLAIN_GAP, LETTERS, BARE_SPACE, SPACE = "_", "=", "~", "^", "z", "s"
_TABLE_OF = {BARE: 1, BARE_LETTERS: 1, BARE_SPACE: 1, PLAIN_GAP: 2, LETTERS: 2, SPACE: 2}
#: The blank between Thai letters, a boundary by definition.
FIXED = "T"


def table_of(kind: str) -> int:
    return _TABLE_OF.get(kind, 0)


def mark_kind(mark: str) -> str:
    """Full stop, question or exclamation mark, ellipsis, mark of another script."""
    return "w" if mark[0] in _WIDE else "e" if mark[0] == "…" or mark[:2] == ".." else mark[0] if mark[0] == "." else "!"


def pairs_of(line: str) -> list[tuple[int, int]]:
    if line.isascii() and "(" not in line and '"' not in line:
        return []
    return [p.span() for p in _PAIR.finditer(line)] if _OPENERS.search(line) else []


def marked_gaps(line: str, prefix: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
    """Gaps with a mark where a sentence may end: (end, next start, start of the mark and what closes it, kind)."""
    stop = len(line.rstrip())
    out = []
    at = max(0, prefix - 1)
    # a plain set of characters is found faster than the pattern
    while mark := _ANY_MARK.search(line, at):
        at = mark.end()
        if not (m := _CANDIDATE.match(line, mark.start())):
            continue
        at = m.end()
        end, nxt = m.end(2), m.end(3)
        if end <= prefix or nxt >= stop:
            continue
        mark = m[1]
        follower = line[nxt]
        if end == nxt and not (mark[0] in _WIDE or mark[0] == "…") and not (mark != "." and _DENSE_CHAR.match(follower)):
            continue
        if follower in ",;:，；：、،؛)]}»”」』）":
            continue
        held = "-"
        if pairs and (pair := holder(pairs, m.start())):
            s, e = pair
            if end < e:
                held = ""
            else:
                lead = line[:s].rstrip()
                held = "h" if s > prefix and lead and lead[-1] not in ".!?…:：" + _WIDE + _CLOSE else "f"
        if held:
            out.append((end, nxt, end - _tail(line, end), mark_kind(mark) + ("c" if m[2] else "-") + follower_kind(line[opened(line, nxt)]) + ("o" if held == "-" and follower in _OPEN else held)))
    return out


def contexts(words: list[str]) -> list[str]:
    """Words as what stands before a gap: short ones with the word before them."""
    return [w if len(w) > 2 else f"{p} {w}" for p, w in zip(["^", *words], words)]


def left(word: str) -> str:
    """The token before a gap without a mark, of a word in its context."""
    head, _, w = word.rpartition(" ")
    w = w.rstrip(_CLOSERS)
    if w and _DENSE_CHAR.match(w[-1]):
        return w[-2:]
    return _DIGITS.sub("9", f"{head} {w}" if head else _EDGE.sub("", w))


def right(word: str) -> str:
    """The token after a gap without a mark."""
    return after(word, 0)


#: What the words beside a gap say of it: none may end there, Thai, a script without spaces.
_NOT, _IS_THAI, _IS_SPACELESS = 1, 2, 4


def _script(c: str) -> int:
    return (_IS_THAI if _THAI.match(c) else 0) | (_IS_SPACELESS if _SPACELESS.match(c) else 0)


@lru_cache(1 << 17)
def ends_with(x: str) -> tuple[int, int, int]:
    """What a word in its context says of the gap behind it, the bucket of its token and of its shape."""
    none = x[-1] in _NO_END or x[-1] in _OPEN_ONLY or _ANY_MARK.search(x, len(x) - _tail(x, len(x))) or not any(map(str.isalnum, x.rpartition(" ")[2]))
    return _script(x[-1]) | (_NOT if none else 0), *hashed(left(x))


@lru_cache(1 << 17)
def begins_with(y: str) -> tuple[int, int, int]:
    """What a word says of the gap before it, the bucket of its token and of its shape."""
    none = y[0] in _NO_END or y[0] in _CLOSE_ONLY or _ANY_MARK.match(y) or not any(map(str.isalnum, y))
    return _script(y[0]) | (_NOT if none else 0), *hashed(right(y))


def word_gap(x: str, y: str, kind: str) -> str | None:
    """Kind of the gap without a mark between two words, ``kind`` unless their script says more; None where there is a mark or none may end."""
    e, b = ends_with(x)[0], begins_with(y)[0]
    if e & b & _IS_THAI:
        return FIXED
    if (e | b) & _NOT:
        return None
    return (BARE_SPACE if kind == BARE else SPACE) if e & b & _IS_SPACELESS else kind


class Words(dict):
    """Different words, numbered."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n

    @property
    def bits(self) -> int:
        return BITS if len(self) <= FEW else MORE_BITS


#: A place in a line is coded as the word before in bits 2 * bits and up (0 where it does not matter, 1 where there is none), the word, the next one. Up to so many words the bits of an integer do, Python's integers beyond.
FEW, BITS, MORE_BITS = (1 << 21) - 2, 21, 40


def places(flat: list[int], words: Words) -> np.ndarray:
    """Codes of the gaps between words of lines, each line's words followed by -1; -1 where two lines meet."""
    w = np.array(flat, dtype=np.int64)
    if not words:
        return np.full(max(0, len(w) - 1), -1, dtype=np.int64)
    short = np.fromiter((len(k) <= 2 for k in words), dtype=bool, count=len(words))
    x, y = w[:-1], w[1:]
    head = np.where(short[x], np.concatenate([[-1], w[:-2]]) + 2, 0) if len(x) else x
    none, bits = (x < 0) | (y < 0), words.bits
    if bits > BITS:
        x, y, head = x.astype(object), y.astype(object), head.astype(object)
    return np.where(none, -1, (head << 2 * bits) | (x << bits) | y)


def gaps_at(codes: np.ndarray, words: Words, kind: str) -> dict[str, np.ndarray]:
    """The gaps of different codes, as columns b, bs, a, as, kind; kind is empty where none may end."""
    names, width = list(words), words.bits
    out: dict[str, np.ndarray] = {}
    bits = []
    for c, own, of in (("b", codes >> width, lambda u: ends_with((f"{names[(u >> width) - 2] if u >> width > 1 else '^'} " if u >> width else "") + names[u & (1 << width) - 1])), ("a", codes & (1 << width) - 1, lambda u: begins_with(names[u]))):
        different, at = np.unique(own, return_inverse=True)
        cols = np.array([of(u) for u in different.tolist()], dtype=np.int64).reshape(-1, 3)[at]
        bits.append(cols[:, 0])
        out[c], out[c + "s"] = cols[:, 1], cols[:, 2]
    both, any_ = bits[0] & bits[1], bits[0] | bits[1]
    space = BARE_SPACE if kind == BARE else SPACE
    out["kind"] = np.where(both & _IS_THAI > 0, FIXED, np.where(any_ & _NOT > 0, "", np.where(both & _IS_SPACELESS > 0, space, kind))).astype(object)
    return out


def letter_gap(b: str, a: str) -> bool:
    """Whether a boundary may stand between these letters of a script without spaces."""
    return not (a[0] in _WIDE or b[-1] in _WIDE or b[-1] in _LEADS or unicodedata.category(a[0])[0] == "M" or b[-1].isdigit() and a[0].isdigit())


def letters(run: str):
    """The two letters before and the three after each gap of a run."""
    return zip([run[:1], *map("".join, zip(run, run[1:]))], [run[i : i + 3] for i in range(1, len(run))])


def holder(pairs: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    """The pair, of pairs in order that do not overlap, that holds a place."""
    i = bisect_left(pairs, (at,))
    return pairs[i - 1] if i and at < pairs[i - 1][1] else None


def held(pairs: list[tuple[int, int]], at: int) -> bool:
    return bool(pairs) and holder(pairs, at) is not None


def word_gaps(line: str, prefix: int) -> list[tuple[int, int, str, str]]:
    """Gaps between words: (end, next start, word before in its context, word after)."""
    words = list(_WORD.finditer(line, prefix))
    own = [m.group() for m in words]
    return [(m.end(), n.start(), x, y) for m, n, x, y in zip(words, words[1:], contexts(own), own[1:])]


def kinds_of(text: str) -> tuple[str, str, bool]:
    """Kinds of a text's gaps without a mark, between words and between letters; whether it has scripts without spaces."""
    dense = not text.isascii() and _DENSE_CHAR.search(text) is not None
    bare = unmarked(text)
    return BARE if bare else PLAIN_GAP, BARE_LETTERS if bare and not (dense and _SPACELESS_GAP.search(text)) else LETTERS, dense


def unmarked(text: str) -> bool:
    """Whether a text has no mark that could end a sentence."""
    return not _ANY_MARK.search(text)


def _tail(line: str, end: int) -> int:
    """Length of the marks and closers that end at ``end``."""
    at = end
    while at > 0 and (line[at - 1] in '"”’»)]」』）】〉》›＂\'' or line[at - 1] in "!?…‼⁇⁈⁉." or line[at - 1] in _WIDE):
        at -= 1
    return end - at


#: Kinds of counted rows: ends and starts of lines, words without a mark, gaps, totals; ends and starts that teach gaps without a mark, in texts without any and in others.
END, START, WORD, GAP, TOTAL, BARE_END, BARE_START, OPEN_END, OPEN_START = range(9)


def gather(texts: list[str | None]) -> Counter:
    """What these texts teach, as counts of (row kind, before, its shape, after, its shape, kind of gap)."""
    ends, starts, words, gaps = Counter(), Counter(), Counter(), Counter()
    bare_ends, bare_starts, open_ends, open_starts = Counter(), Counter(), Counter(), Counter()
    # gaps without a mark: by the letters around them; words of lines, and places among them that quotations and brackets hold
    by_letters: dict[str, Counter] = {BARE_LETTERS: Counter(), LETTERS: Counter()}
    numbers, flat, out_of = Words(), {BARE: [], PLAIN_GAP: []}, {BARE: [], PLAIN_GAP: []}
    total: Counter = Counter()
    for text in texts:
        if not text:
            continue
        kind_w, kind_l, dense = kinds_of(text)
        bare = kind_w == BARE
        taught = not bare or len(text.split()) + (len(_DENSE_CHAR.findall(text)) if dense else 0) >= BARE_WORDS
        for _, line in lines_of(text):
            line = line.rstrip()
            at = _PREFIX.match(line).end()
            if at >= len(line):
                words.update(line.split())
                continue
            own = line[at:].split()
            if at:
                words.update(line[:at].split())
            total["lines"] += 1
            total["short lines"] += len(line) - at < 3 * SHORT and sum(map(str.isalnum, line[at:])) < SHORT
            if not line[at].islower():
                starts[after(line, at)] += 1
            tail = _tail(line, len(line))
            if tail:
                ends[before(line, len(line) - tail)] += 1
            pairs = pairs_of(line)
            last = None
            for end, nxt, mark, kind in marked_gaps(line, at, pairs):
                gaps[before(line, mark), after(line, nxt), kind] += 1
                if last is not None:
                    total["pairs"] += 1
                    total["near pairs"] += end - last < SHORT
                last = nxt
            if not taught:
                words.update(own)
                continue
            if pairs:
                stops, first = [m.end() for m in _WORD.finditer(line, at)], len(flat[kind_w])
                for s, e in pairs:
                    out_of[kind_w].extend(range(first + bisect_right(stops, s), first + bisect_left(stops, e)))
            flat[kind_w].extend(map(numbers.__getitem__, own))
            flat[kind_w].append(-1)
            if dense:
                for run in _DENSE_RUN.finditer(line, at):
                    if not pairs or not held(pairs, run.start()):
                        by_letters[kind_l].update(letters(run.group()))
            if bare:
                bare_starts[right(own[0])] += 1
                bare_ends[left(contexts(own[-2:])[-1])] += 1
                total["ends " + (kind_l if dense and _DENSE_CHAR.match(own[-1][-1]) else BARE)] += 1
            elif last is not None:
                # a line of several sentences: whether the last one has a mark
                total["prose"] += 1
                open_starts[right(own[0])] += 1
                if not _ANY_MARK.search(line, len(line) - tail) and line[-1] not in _NO_END:
                    total["open"] += 1
                    open_ends[left(contexts(own[-2:])[-1])] += 1
    for k, own in by_letters.items():
        for (x, y), n in own.items():
            if letter_gap(x, y):
                gaps[x, y, k] += n
    out: Counter = Counter({(TOTAL, 0, 0, 0, 0, name): n for name, n in total.items() if n})
    for t, own in ((END, ends), (BARE_END, bare_ends), (OPEN_END, open_ends)):
        for b, n in own.items():
            out[t, *hashed(b), 0, 0, ""] += n
    for t, own in ((START, starts), (BARE_START, bare_starts), (OPEN_START, open_starts)):
        for a, n in own.items():
            out[t, 0, 0, *hashed(a), ""] += n
    all_words = np.array([w for own in flat.values() for w in own], dtype=np.int64)
    for w, n in zip(numbers, np.bincount(all_words[all_words >= 0], minlength=len(numbers)).tolist()):
        words[w] += n
    for w, n in words.items():
        if len(w) > 2 and w.isalpha() and not _DENSE_CHAR.match(w):
            out[WORD, *hashed(w), 0, 0, ""] += n
    for (b, a, kind), n in gaps.items():
        i, s = hashed(b)
        out[GAP, i, s, *hashed(a), kind if table_of(kind) else kind + OPENS[s // 256]] += n
    for k, own in flat.items():
        codes = places(own, numbers)
        codes[out_of[k]] = -1
        codes, n = np.unique(codes, return_counts=True)
        n = n[codes >= 0]
        cols = gaps_at(codes[codes >= 0], numbers, k)
        for b, bs, a, a_s, kind, v in zip(*(cols[c].tolist() for c in ("b", "bs", "a", "as", "kind")), n.tolist()):
            if kind == FIXED:
                out[OPEN_END, b, bs, 0, 0, ""] += v
                out[OPEN_START, 0, 0, a, a_s, ""] += v
            elif kind:
                out[GAP, b, bs, a, a_s, kind] += v
    return out


def logit(p):
    return np.log(p) - np.log1p(-p)


def unseen(kind: str) -> float:
    if kind in (SPACE, BARE_SPACE):
        return UNSEEN_YES
    return 1e-9 if table_of(kind) else UNSEEN_NO if kind[2] == "l" or kind[3] == "h" else UNSEEN_YES


_KEYS = ((0x9E3779B1, 0x27D4EB2F, 0x165667B1, 0x2545F491), (0x85EBCA6B, 0xC2B2AE35, 0x6C8E9CF5, 0x1B873593))


def ngram(b, a, sa, bare) -> list[list]:
    """Places in the bigrams' counts, a list of hash rows each: of a pair of words, of the word before with how the next opens, of the number of different words that follow so."""
    out = []
    for what in (1, 2, 3):
        rows = []
        for row, (kb, ka, ko, kw) in enumerate(_KEYS[:ROWS]):
            key = b * kb + (sa // 256) * ko + what * kw + (a * ka if what == 1 else 0)
            rows.append((bare * ROWS + row) * NGRAMS + (key ^ key >> 15) % NGRAMS)
        out.append(rows)
    return out


@dataclass
class Model:
    """Log odds of a boundary by the words before and after a gap and by its kind; words not seen have those of their shape.

    The words have tables for gaps with and without a mark; the odds of a word are those
    among the words that open alike, as the kind of the gap says how they open.
    """

    before: np.ndarray | None = None  # (TABLES, BUCKETS), nan where not seen
    after: np.ndarray | None = None
    before_shape: np.ndarray | None = None  # (TABLES, SHAPES)
    after_shape: np.ndarray | None = None
    kinds: dict[str, float] = field(default_factory=dict)
    short: float = 0.0
    #: Expected counts of bigrams without a boundary, and each next word's share without one; none before the first round.
    pairs: np.ndarray | None = None  # (2 * ROWS * NGRAMS,)
    plain: np.ndarray | None = None  # (TABLES, BUCKETS)
    _odds: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_odds": {}}

    def kind(self, kind: str) -> float:
        p = self.kinds.get(kind)
        p = unseen(kind) if p is None else p
        return math.log(p) - math.log1p(-p)

    def odds(self, b: str, a: str, kind: str) -> float:
        (i, si), (j, sj) = hashed(b), hashed(a)
        g = table_of(kind)
        out = self.kind(kind if g else kind + OPENS[si // 256])
        if self.before is not None:
            x, y = self.before[g, i], self.after[g, j]
            out += float(self.before_shape[g, si] if x != x else x) + float(self.after_shape[g, sj] if y != y else y)
        if self.pairs is not None:
            ba, bo, ways = (min(float(self.pairs[k]) for k in rows) for rows in ngram(i, j, sj, int(g > 0)))
            alone = float(self.plain[g, j])
            out -= math.log(((max(0.0, ba - 1) / alone if alone > 0 else 0.0) + ways + BACKOFF) / (bo + BACKOFF))
        return out

    def marked_odds(self, b: str, a: str, kind: str) -> float:
        """``odds``, kept."""
        kept = self._odds.setdefault("", {})
        out = kept.get((b, a, kind))
        if out is None:
            if len(kept) >= KEPT:
                kept.clear()
            out = kept[b, a, kind] = self.odds(b, a, kind)
        return out

    def plain_odds(self, around: list[tuple[str, str]], kind: str) -> list[float]:
        """Log odds of gaps without a mark by the words or letters around them."""
        kept = self._odds.setdefault(kind, {})
        out = list(map(kept.get, around))
        if None in out:
            if len(kept) >= KEPT:
                kept.clear()
            for at, (x, y) in enumerate(around):
                if out[at] is None:
                    if kind in (BARE_LETTERS, LETTERS):
                        o = self.odds(x, y, kind) if letter_gap(x, y) else -math.inf
                    else:
                        own = word_gap(x, y, kind)
                        o = -math.inf if own is None else math.inf if own == FIXED else self.odds(left(x), right(y), own)
                    out[at] = kept[x, y] = o
        return out


@dataclass
class Counts:
    """Dense counts of words and shapes that ends, starts and gaps without a boundary have."""

    word: np.ndarray
    shape: np.ndarray

    @classmethod
    def zero(cls) -> Counts:
        return cls(np.zeros(BUCKETS), np.zeros(SHAPES))

    def add(self, i, s, n) -> None:
        np.add.at(self.word, i, n)
        np.add.at(self.shape, s, n)

    def p(self, members: np.ndarray, shape_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each bucket among those that open alike, backed off to its shape, and of a word not seen by shape; ``members`` words a shape."""
        kind = np.arange(SHAPES) // 256
        total = np.bincount(shape_of // 256, self.word, 6)
        alike = np.bincount(kind, members, 6)
        back = (self.shape + 0.02) / (total + 0.02 * np.maximum(1, alike))[kind] / np.maximum(1, members)
        return (self.word + BACKOFF * back[shape_of]) / (total + BACKOFF)[shape_of // 256], (self.shape + 0.02) / (total + 1)[kind]


#: Rows of training: distinct gaps with their number.
_GAPS = ["b", "bs", "a", "as", "kind", "n"]


def tables_of(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different kinds, the kind of each row among them, its table."""
    kinds, at = np.unique(kinds.astype(str), return_inverse=True)
    return kinds, at, np.array([table_of(k) for k in kinds], dtype=np.int64)[at] if len(kinds) else np.zeros(0, dtype=np.int64)


def log_odds(gaps: dict[str, np.ndarray], model: Model) -> np.ndarray:
    """Log odds of a boundary at each distinct gap, each on its own."""
    kinds, at, g = tables_of(gaps["kind"])
    odds = np.array([model.kind(k) for k in kinds])[at] if len(kinds) else np.zeros(0)
    if model.before is not None:
        for words, shapes, i, s in ((model.before, model.before_shape, gaps["b"], gaps["bs"]), (model.after, model.after_shape, gaps["a"], gaps["as"])):
            x = words[g, i]
            odds = odds + np.where(np.isnan(x), shapes[g, s], x)
    if model.pairs is not None:
        ba, bo, ways = (np.minimum.reduce([model.pairs[k] for k in rows]).astype(float) for rows in ngram(gaps["b"], gaps["a"], gaps["as"], (g > 0).astype(np.int64)))
        alone = model.plain[g, gaps["a"]].astype(float)
        odds = odds - np.log((np.divide(np.maximum(0, ba - 1), alone, out=np.zeros(len(ba)), where=alone > 0) + ways + BACKOFF) / (bo + BACKOFF))
    return odds


def posterior(gaps: dict[str, np.ndarray], model: Model) -> np.ndarray:
    """Probability of a boundary at each distinct gap, each on its own."""
    return 1 / (1 + np.exp(-np.clip(log_odds(gaps, model), -30, 30)))


class Expected:
    """Expected counts of one round: boundaries and gaps by kind, words and shapes at gaps with and without a boundary, bigrams without one."""

    def __init__(self):
        self.kinds: Counter = Counter()
        self.words = {sign + c: np.zeros((TABLES, size)) for sign in "-+" for c, size in (("b", BUCKETS), ("a", BUCKETS), ("bs", SHAPES), ("as", SHAPES))}
        self.pairs = np.zeros(2 * ROWS * NGRAMS)

    def add(self, gaps: dict[str, np.ndarray], model: Model) -> None:
        q, n = posterior(gaps, model), gaps["n"].astype(float)
        kinds, at, g = tables_of(gaps["kind"])
        for name, w in (("yes", q * n), ("all", n)):
            for k, v in zip(kinds, np.bincount(at, w, len(kinds))):
                self.kinds[f"{name} {k}"] += float(v)
        for c in ("b", "a", "bs", "as"):
            np.add.at(self.words["-" + c], (g, gaps[c]), (1 - q) * n)
            np.add.at(self.words["+" + c], (g, gaps[c]), q * n)
        # by how much likelier none is: the shares that boundaries have in it would make bigrams of their words
        no = np.maximum(0.0, 1 - 2 * q)
        for rows, w in zip(ngram(gaps["b"], gaps["a"], gaps["as"], (g > 0).astype(np.int64)), (no * n, no * n, no)):
            for k in rows:
                np.add.at(self.pairs, k, w)

    def rows(self) -> pa.RecordBatch:
        """All that is not 0, as columns name, i and v."""
        parts = [(k, np.zeros(1, dtype=np.int32), np.array([v])) for k, v in self.kinds.items()]
        for k, v in (*self.words.items(), ("pairs", self.pairs)):
            i = np.flatnonzero(v.ravel() > 1e-9)
            parts.append((k, i.astype(np.int32), v.ravel()[i]))
        names = pa.concat_arrays([pa.repeat(pa.scalar(k), len(i)) for k, i, _ in parts])
        return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([i for _, i, _ in parts])), pa.array(np.concatenate([v for *_, v in parts]))], names=["name", "i", "v"])

    @classmethod
    def of(cls, rows: pa.Table) -> Expected:
        out = cls()
        names = rows["name"].combine_chunks().dictionary_encode()
        at, i, v = names.indices.to_numpy(), rows["i"].to_numpy(), rows["v"].to_numpy()
        for code, k in enumerate(names.dictionary.to_pylist()):
            own = at == code
            if k == "pairs" or k in out.words:
                (out.pairs if k == "pairs" else out.words[k]).reshape(-1)[i[own]] = v[own]
            else:
                out.kinds[k] = float(v[own].sum())
        return out


class Trainer:
    """Rounds of expectation-maximisation from summed counts."""

    def __init__(self, rows: dict[str, np.ndarray]):
        """``rows`` as ``gather`` counts them, but without gaps: columns t, b, bs, a, as, kind, n."""
        own = lambda t: rows["t"] == t
        self.ends, self.starts, word = Counts.zero(), Counts.zero(), Counts.zero()
        self.ends.add(rows["b"][own(END)], rows["bs"][own(END)], rows["n"][own(END)])
        self.starts.add(rows["a"][own(START)], rows["as"][own(START)], rows["n"][own(START)])
        word.add(rows["b"][own(WORD)], rows["bs"][own(WORD)], rows["n"][own(WORD)])
        self.total = {k: float(n) for k, n in zip(rows["kind"][own(TOTAL)], rows["n"][own(TOTAL)])}
        # a word that also stands without a mark is no abbreviation, even if it ends no line
        if word.word.sum():
            self.ends.word += PLAIN * max(1.0, self.ends.word.sum()) * word.word / word.word.sum()
        self.shape_of = {"b": np.zeros(BUCKETS, dtype=np.int64), "a": np.zeros(BUCKETS, dtype=np.int64)}
        # what ends and starts lines where gaps have no mark, by table
        self.bare = {(c, g): Counts.zero() for c in "ba" for g in (1, 2)}
        for t, c, g in ((BARE_END, "b", 1), (BARE_START, "a", 1), (OPEN_END, "b", 2), (OPEN_START, "a", 2)):
            self.bare[c, g].add(rows[c][own(t)], rows[c + "s"][own(t)], rows["n"][own(t)])
            self.shape_of[c][rows[c][own(t)]] = rows[c + "s"][own(t)]
        for t, c in ((END, "b"), (WORD, "b"), (START, "a")):
            self.shape_of[c][rows[c][own(t)]] = rows[c + "s"][own(t)]
        self.seen = {"b": self.ends.word > 0, "a": self.starts.word > 0}

    def first(self) -> Model:
        """The model before the first round: marks are mostly boundaries, gaps without one are none."""
        return Model(short=self.short_odds())

    def short_odds(self) -> float:
        """Log odds of a sentence of almost no length: how rare such lines are against how often marks stand so near."""
        lines = (self.total.get("short lines", 0.0) + 1) / (self.total.get("lines", 0.0) + 2)
        pairs = (self.total.get("near pairs", 0.0) + 1) / (self.total.get("pairs", 0.0) + 2)
        return min(0.0, math.log(lines / pairs))

    def next(self, summed: Expected, shapes: dict[str, np.ndarray], number: int) -> Model:
        """The model of the expected counts of round ``number``. ``shapes`` has each bucket's shape as gaps with a mark have it ("b", "a") and others ("~b", "~a"), -1 where unknown."""
        n = TABLES
        m = Model(np.full((n, BUCKETS), np.nan, dtype=np.float32), np.full((n, BUCKETS), np.nan, dtype=np.float32), np.zeros((n, SHAPES)), np.zeros((n, SHAPES)), short=self.short_odds())
        plain = np.zeros((n, BUCKETS), dtype=np.float32)
        learnt = number >= LINES_ALONE
        for c, yes, words, by_shape in (("b", self.ends, m.before, m.before_shape), ("a", self.starts, m.after, m.after_shape)):
            for g in range(n):
                at = shapes["~" * (g > 0) + c]
                shape_of = np.where(at >= 0, at, self.shape_of[c])
                known = self.seen[c] | (at >= 0) if g == 0 else (at >= 0) | (self.bare[c, g].word > 0)
                own = yes if g == 0 else self.bare[c, g]
                members = np.bincount(shape_of[known], minlength=SHAPES).astype(float)
                # where no boundary is, texts without marks read like others
                no, yes_ = (Counts(*(summed.words[f"-{c}{x}"][[g] if g == 0 else [1, 2]].sum(0) for x in ("", "s"))), Counts(own.word.copy(), own.shape.copy()))
                if learnt:
                    yes_.word += summed.words["+" + c][g]
                    yes_.shape += summed.words[f"+{c}s"][g]
                (py, sy), (pn, sn) = yes_.p(members, shape_of), no.p(members, shape_of)
                words[g, known] = np.log(py[known] / pn[known])
                by_shape[g] = np.log(sy / sn)
                if c == "a":
                    plain[g, known] = pn[known]
        m.pairs, m.plain = summed.pairs.astype(np.float32), plain
        gaps = {k[4:]: v for k, v in summed.kinds.items() if k.startswith("all ")}
        # gaps without a mark in texts with marks: at first as many boundaries as lines of several sentences that end without one let expect
        inner = sum(summed.kinds.get(f"yes {k}", 0.0) for k in gaps if not table_of(k))
        plain_gaps = gaps.get(PLAIN_GAP, 0.0) + gaps.get(LETTERS, 0.0)
        missing = self.total.get("open", 0.0) / max(1.0, self.total.get("prose", 0.0))
        expected = missing / max(1e-9, 1 - missing) * inner / max(1.0, plain_gaps)
        for k, v in gaps.items():
            yes = summed.kinds.get(f"yes {k}", 0.0)
            if k in (BARE, BARE_LETTERS):
                # the lines of texts without marks, against the gaps within them
                ends = self.total.get("ends " + k, 0.0)
                m.kinds[k] = float(np.clip((ends + yes + 1e-9) / (ends + v + 1), 1e-9, 0.5))
                continue
            first = float(np.clip(expected, 1e-9, 0.5)) if k in (PLAIN_GAP, LETTERS) else unseen(k)
            if k in (PLAIN_GAP, LETTERS) and not learnt:
                m.kinds[k] = first
            else:
                m.kinds[k] = float(np.clip((yes + (1 + PRIOR * v) * first) / (v + 1 + PRIOR * v), 1e-9, 1 - 1e-6))
        return m


def _columns(counts: Counter) -> dict[str, np.ndarray]:
    rows = [(*k, n) for k, n in counts.items()]
    cols = list(zip(*rows)) if rows else [()] * 7
    kinds = [np.int64] * 5 + [object, np.float64]
    return {name: np.array(c, dtype=k) for name, c, k in zip(["t", "b", "bs", "a", "as", "kind", "n"], cols, kinds)}


def train(texts: list[str | None], rounds: int = ROUNDS) -> Model:
    """The model of these texts, trained in this process. Without texts a mark before no lower-case letter is a boundary."""
    rows = _columns(gather(texts))
    gap = rows["t"] == GAP
    if not len(gap):
        return Model()
    gaps = {c: rows[c][gap] for c in _GAPS}
    trainer = Trainer({c: v[~gap] for c, v in rows.items()})
    _, _, g = tables_of(gaps["kind"])
    shapes = {}
    for name, own in (("", g == 0), ("~", g > 0)):
        for c in "ba":
            shapes[name + c] = np.full(BUCKETS, -1, dtype=np.int64)
            order = np.argsort(-gaps[c + "s"][own], kind="stable")  # the least shape of a bucket is written last
            shapes[name + c][gaps[c][own][order]] = gaps[c + "s"][own][order]
    model = trainer.first()
    for number in range(rounds):
        summed = Expected()
        summed.add(gaps, model)
        model = trainer.next(summed, shapes, number)
    return model


def posteriors(gaps: list[tuple[int, int, float, bool]], short: float) -> list[float]:
    """Probability of a boundary at each gap (end, next start, log odds, whether it has a mark), by forward-backward over the sentences between boundaries.

    A sentence of less than SHORT characters between two boundaries with a mark, or two without,
    has the log odds ``short``. Sums over all that may stand before and behind a gap are shares of
    the sum without that gap, so that nothing overflows.
    """
    n = len(gaps)
    w = [math.exp(max(-30.0, min(30.0, g[2]))) for g in gaps]
    less = 1 - math.exp(short)
    if n == 1 or not less or all(b[0] - a[1] >= SHORT for a, b in zip(gaps, gaps[1:])):
        return [x / (1 + x) for x in w]

    def alike(found, i):
        return sum(x for j, x in found if gaps[j][3] == gaps[i][3])

    def run(order, apart):
        """For each gap, the gaps near it at which the boundary next to it may stand, with their shares."""
        out: list[list[tuple[int, float]]] = [[]] * n
        recent: list[tuple[int, float]] = []
        for i in order:
            recent = out[i] = [(j, x) for j, x in recent if apart(j, i) < SHORT]
            r = w[i] * (1 - less * alike(recent, i))
            recent = [(j, x / (1 + r)) for j, x in recent] + [(i, r / (1 + r))]
        return out

    back = run(range(n), lambda j, i: gaps[i][0] - gaps[j][1])
    on = run(range(n - 1, -1, -1), lambda j, i: gaps[j][0] - gaps[i][1])
    p = []
    for i in range(n):
        across = sum(x * y for j, x in back[i] for k, y in on[i] if gaps[j][3] == gaps[k][3] and gaps[k][0] - gaps[j][1] < SHORT) if back[i] and on[i] else 0.0
        r = w[i] * (1 - less * alike(back[i], i)) * (1 - less * alike(on[i], i)) / (1 - less * across)
        p.append(r / (1 + r))
    return p


def line_gaps(line: str, prefix: int, kinds: tuple[str, str, bool], model: Model, words: bool = True) -> list[tuple[int, int, float, bool]]:
    """All gaps of a line in order, with their log odds and whether they have a mark: behind marks, between words unless not asked for, between letters."""
    kind_w, kind_l, dense = kinds
    pairs = pairs_of(line)
    out = [(end, nxt, model.marked_odds(before(line, mark), after(line, nxt), kind), True) for end, nxt, mark, kind in marked_gaps(line, prefix, pairs)]
    if words:
        own = word_gaps(line, prefix)
        for (end, nxt, _, _), o in zip(own, model.plain_odds([g[2:] for g in own], kind_w)):
            if o > FLOOR and (o == math.inf or not held(pairs, end)):
                out.append((end, nxt, o, False))
    if dense:
        for run in _DENSE_RUN.finditer(line, prefix):
            if not held(pairs, run.start()):
                odds = model.plain_odds(list(letters(run.group())), kind_l)
                if max(odds) > FLOOR:
                    out += [(at, at, o, False) for at, o in enumerate(odds, run.start() + 1) if o > FLOOR]
    out.sort()
    return out


def with_word_gaps(lines: list[tuple[str, int, str]], model: Model) -> list[bool]:
    """Which lines (line, prefix, kind of its gaps) have a gap between words that forward-backward must see; all lines are scored at once."""
    numbers, flat, of = Words(), {BARE: [], PLAIN_GAP: []}, {BARE: [], PLAIN_GAP: []}
    for at, (line, prefix, kind) in enumerate(lines):
        own = line[prefix:].split()
        flat[kind].extend(map(numbers.__getitem__, own))
        flat[kind].append(-1)
        of[kind].append((at, len(own) + 1))
    out = np.zeros(len(lines), dtype=bool)
    for kind, own in flat.items():
        codes = places(own, numbers)
        gap = np.flatnonzero(codes >= 0)
        if not len(gap):
            continue
        different, at = np.unique(codes[gap], return_inverse=True)
        gaps = gaps_at(different, numbers, kind)
        fixed, none = gaps["kind"] == FIXED, gaps["kind"] == ""
        gaps["kind"][fixed | none] = kind
        seen = (fixed | (log_odds(gaps, model) > FLOOR)) & ~none
        lines_, sizes = np.array(of[kind]).T
        out[np.repeat(lines_, sizes)[gap[seen[at]]]] = True
    return out.tolist()


def sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, without surrounding blanks."""
    return sentences_of([text], model)[0]


def sentences_of(texts: list[str | None], model: Model) -> list[list[tuple[int, int]]]:
    """Spans of the sentences of each text."""
    parsed = [(kinds_of(t), [(base, line, _PREFIX.match(line).end()) for base, line in lines_of(t)]) if t else ((BARE, LETTERS, False), []) for t in texts]
    words = iter(with_word_gaps([(line, prefix, kinds[0]) for kinds, lines in parsed for _, line, prefix in lines], model))
    return [[span for base, line, prefix in lines for span in _line_sentences(base, line, line_gaps(line, prefix, kinds, model, next(words)), model)] for kinds, lines in parsed]


def _line_sentences(base: int, line: str, gaps: list[tuple[int, int, float, bool]], model: Model) -> list[tuple[int, int]]:
    out = []
    cuts = [(end, nxt) for (end, nxt, _, _), p in zip(gaps, posteriors(gaps, model.short)) if p > 0.5] if gaps else []
    start = 0
    for end, nxt in [*cuts, (len(line), len(line))]:
        part = line[start:end]
        s = part.strip()
        if s:
            at = base + start + len(part) - len(part.lstrip())
            out.append((at, at + len(s)))
        start = nxt
    return out


def fit(spark: SparkSession, df: DataFrame, text: str) -> Model:
    """The model of all texts of the table.

    One pass counts words and distinct gaps; each round of training is a job over
    the distinct gaps. What comes back to the driver has at most a row for each
    bucket, shape and kind of gap, and for each bucket of the bigrams.
    """
    schema = "t bigint, b bigint, bs bigint, a bigint, `as` bigint, kind string, n double"

    def count(batches):
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                cols = _columns(gather(texts))
                yield pa.RecordBatch.from_arrays([pa.array(cols[c].astype(str) if c == "kind" else cols[c]) for c in cols], names=list(cols))

    rows = df.select(text).filter(F.col(text).isNotNull()).mapInArrow(count, schema)
    rows = materialize(spark, rows.groupBy("t", "b", "bs", "a", "as", "kind").agg(F.sum("n").alias("n")), "gaps")
    others = rows.filter(F.col("t") != GAP).toPandas()
    if others.empty:
        return Model()
    trainer = Trainer({c: others[c].to_numpy() for c in others.columns})
    gaps = rows.filter(F.col("t") == GAP).drop("t")
    side = lambda c: F.struct(F.lit(c).alias("c"), F.col(c).alias("i"), F.col(c + "s").alias("s"))
    own = gaps.select(F.col("kind").isin(*_TABLE_OF).alias("plain"), F.explode(F.array(side("b"), side("a"))).alias("x")).groupBy("plain", "x.c", "x.i").agg(F.min("x.s").alias("s")).toPandas()
    shapes = {}
    for plain in (False, True):
        for c in "ba":
            rows_ = own[(own["plain"] == plain) & (own["c"] == c)]
            shapes["~" * plain + c] = np.full(BUCKETS, -1, dtype=np.int64)
            shapes["~" * plain + c][rows_["i"].to_numpy()] = rows_["s"].to_numpy()
    model = trainer.first()
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            total = Expected()
            for b in batches:
                total.add({c: np.array(b.column(c).to_pylist(), dtype=object) if c == "kind" else b.column(c).to_numpy() for c in _GAPS}, shared.value)
            rows = total.rows()
            for at in range(0, rows.num_rows, 1 << 16):
                yield rows.slice(at, 1 << 16)

        summed = gaps.mapInArrow(run, "name string, i int, v double").groupBy("name", "i").agg(F.sum("v").alias("v")).toArrow()
        shared.unpersist()
        model = trainer.next(Expected.of(summed), shapes, number)
    return model


def split_sentences(spark: SparkSession, df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``key, sent_start, sent_end`` of each sentence of each row.

    Null, empty and blank texts have no sentences. Rows are not made distinct.
    """
    shared = spark.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                spans = sentences_of(texts, shared.value)
                n = np.fromiter(map(len, spans), dtype=np.int64, count=len(spans))
                flat = np.array([x for s in spans for x in s], dtype=np.int32).reshape(-1, 2)
                keys = batch.column(0).slice(at, len(texts)).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=[key, "sent_start", "sent_end"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, sent_start int, sent_end int")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("rowid", "text").filter(F.col("text").isNotNull())
    model = fit(spark, chunks, "text")
    # repeated rows go before they are split, not sentence by sentence
    return split_sentences(spark, chunks.distinct(), "rowid", "text", model)


def p1_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by length class (powers of two of characters)."""
    n = F.col("sent_end") - F.col("sent_start")
    return p1_found(spark, sf_dir).groupBy(F.floor(F.log2(n)).alias("log2_chars")).agg(F.count("*").alias("sentences"), F.min(n).alias("least"), F.max(n).alias("most"))


QUERIES = {"p1_found": p1_found, "p1_lengths": p1_lengths}
ORACLE: dict[str, str] = {}
