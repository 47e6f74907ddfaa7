"""Byte-level BPE with a segment tree over byte positions.

Each leaf holds ``rank << SHIFT | position`` of the pair that begins there, so
the root is the leftmost pair of least rank. A merge rewrites three leaves (the
merged position, its live left neighbour and the swallowed right one) and their
ancestors. Many pretokens are encoded side by side: the tree of a block is one
array with a column for each pretoken, and every step is a numpy operation over
the columns that still have a pair to merge.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pretokeniser pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_DIR = os.environ.get("LAVRA_TOKENIZERS", "/opt/tokenizers")
SHIFT = 40  # positions within one pretoken: a tera of bytes, and ranks of 22 bits above
INF = np.int64(1) << 62
BLOCK_CELLS = 1 << 19
CACHE_UNITS = 300_000
CACHE_IDS = 3_000_000

_PRE = regex.compile(PATTERN)
#: A blank that is not one plain space between two visible characters.
_ODD_BLANK = re.compile(r"^ | $|  | [^\S ]|[^\S ] ")


class SegmentTreeBPE:
    """Ranks of a ``.tiktoken`` file and the block encoder over them."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.merged = np.array(merged, dtype=np.int64)[order]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; INF where either part is missing or the pair is no token."""
        key = (left << 32) | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.merged[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each word."""
        n = len(words)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
        counts = np.zeros(n, dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size_of = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens, 2))).astype(np.int64))
        for size in np.unique(size_of):
            which = np.flatnonzero((size_of == size) & (lens > 0))
            step = max(1, BLOCK_CELLS // int(size))
            for at in range(0, len(which), step):
                some = which[at : at + step]
                ids, c = self._block([words[i] for i in some], lens[some], int(size))
                counts[some] = c
                parts.append((some, ids))
        starts = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(int(starts[-1]), dtype=np.int32)
        for some, ids in parts:
            c = counts[some]
            at = np.repeat(starts[some] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(len(ids))
            out[at] = ids
        return out, counts

    def _block(self, words: list[bytes], lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        w = len(words)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.arange(len(raw)) - np.repeat(np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
        col = np.repeat(np.arange(w), lens)
        ids = np.full((size + 1) * w, -1, dtype=np.int64)  # the row behind the last stays -1
        ids[row * w + col] = self.byte_id[raw]
        position = np.repeat(np.arange(size, dtype=np.int64), w)
        after = np.repeat(np.arange(1, size + 2, dtype=np.int64), w)
        after[size * w :] = size
        before = np.repeat(np.arange(-1, size, dtype=np.int64), w)
        tree = np.full(2 * size * w, INF, dtype=np.int64)
        rank = self.pair_rank(ids[: size * w], ids[w:])
        tree[size * w :] = np.where(rank >= 0, rank << SHIFT | position, INF)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[2 * node * w : (2 * node + 1) * w], tree[(2 * node + 1) * w : (2 * node + 2) * w], out=tree[node * w : (node + 1) * w])
        live = np.flatnonzero(tree[w : 2 * w] < INF)
        mask = (np.int64(1) << SHIFT) - 1
        while len(live):
            top = tree[w + live]
            pos, new = top & mask, top >> SHIFT
            at = pos * w + live
            right = after[at]
            nxt = after[right * w + live]
            ids[at] = new
            ids[right * w + live] = -1
            after[at] = nxt
            inner = nxt < size
            before[nxt[inner] * w + live[inner]] = pos[inner]
            prev = before[at]
            has_prev = prev >= 0
            r_here = self.pair_rank(new, ids[nxt * w + live])
            pc = live[has_prev]
            pp = prev[has_prev]
            r_prev = self.pair_rank(ids[pp * w + pc], new[has_prev])
            node = np.concatenate((right, pos, pp)) + size
            cols = np.concatenate((live, live, pc))
            value = np.concatenate((np.full(len(live), INF), np.where(r_here >= 0, r_here << SHIFT | pos, INF), np.where(r_prev >= 0, r_prev << SHIFT | pp, INF)))
            tree[node * w + cols] = value
            while node[0] > 1:
                node >>= 1
                left = 2 * node * w + cols
                tree[node * w + cols] = np.minimum(tree[left], tree[left + w])
            live = live[tree[w + live] < INF]
        grid = ids[: size * w].reshape(size, w).T
        kept = grid >= 0
        return grid[kept], kept.sum(axis=1)


class _Store:
    """Ragged id lists that grow, addressed by number."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)
        self.size = np.zeros(1, dtype=np.int64)  # entry 0 is the empty list

    def add(self, keys: list, flat: np.ndarray, counts: np.ndarray) -> None:
        base = len(self.start)
        self.start = np.concatenate((self.start, len(self.flat) + np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)))
        self.size = np.concatenate((self.size, counts))
        self.flat = np.concatenate((self.flat, flat))
        self.index.update(zip(keys, range(base, base + len(keys))))

    def gather(self, idx: np.ndarray) -> np.ndarray:
        c = self.size[idx]
        shift = self.start[idx] - np.concatenate(([0], np.cumsum(c)[:-1]))
        return self.flat[np.repeat(shift, c) + np.arange(int(c.sum()))] if len(idx) else self.flat[:0]

    @property
    def full(self) -> bool:
        return len(self.index) > CACHE_UNITS or len(self.flat) > CACHE_IDS


def units(text: str) -> list[str]:
    """The text cut at single spaces between visible characters.

    The pretokens of the text are those of each unit, where every unit but the
    first is taken with the space before it.
    """
    pieces = text.split(" ")
    if not _ODD_BLANK.search(text):
        return pieces
    out, cur = [], [pieces[0]]
    for p in pieces[1:]:
        last = cur[-1]
        if p and not p[0].isspace() and last and not last[-1].isspace():
            out.append(" ".join(cur))
            cur = [p]
        else:
            cur.append(p)
    out.append(" ".join(cur))
    return out


class TextEncoder:
    """Encodes batches of texts; keeps bounded caches of units and pretokens between batches."""

    def __init__(self, path: str):
        self.bpe = SegmentTreeBPE(path)
        self.words, self.units, self.firsts = _Store(), _Store(), _Store()

    def _learn(self, store: _Store, keys: list[str], lead: str) -> None:
        pre = [_PRE.findall(lead + k) for k in keys]
        flat = [t for x in pre for t in x]
        new = list(dict.fromkeys(t for t in flat if t not in self.words.index))
        if new:
            # a lone surrogate cannot come out of Spark; errors="replace" only guards other callers
            self.words.add(new, *self.bpe.encode([t.encode("utf-8", "replace") for t in new]))
        idx = np.fromiter(map(self.words.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = np.fromiter(map(len, pre), dtype=np.int64, count=len(pre))
        ends = np.concatenate(([0], np.cumsum(self.words.size[idx])))
        cut = np.concatenate(([0], np.cumsum(n)))
        store.add(keys, self.words.gather(idx), ends[cut[1:]] - ends[cut[:-1]])

    def _index(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for s in (self.units, self.firsts, self.words):
            if s.full:
                s.__init__()
        rows = [units(t) if t else [] for t in texts]
        n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        first = [r[0] for r in rows if r]
        rest = [u for r in rows for u in r[1:]]
        for store, keys, lead in ((self.firsts, first, ""), (self.units, rest, " ")):
            new = list(set(keys).difference(store.index))
            if new:
                self._learn(store, new, lead)
        fi = np.fromiter(map(self.firsts.index.__getitem__, first), dtype=np.int64, count=len(first))
        ri = np.fromiter(map(self.units.index.__getitem__, rest), dtype=np.int64, count=len(rest))
        return n, fi, ri

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text; 0 for null and empty texts."""
        n, fi, ri = self._index(texts)
        out = np.zeros(len(texts), dtype=np.int64)
        some = np.flatnonzero(n > 0)
        out[some] = self.firsts.size[fi]
        ends = np.concatenate(([0], np.cumsum(self.units.size[ri])))
        cut = np.concatenate(([0], np.cumsum(np.maximum(n - 1, 0))))
        return out + ends[cut[1:]] - ends[cut[:-1]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the offset of each text (one more than texts)."""
        n, fi, ri = self._index(texts)
        base = len(self.firsts.flat)
        start = np.concatenate((self.firsts.start, self.units.start + base))
        size = np.concatenate((self.firsts.size, self.units.size))
        idx = np.empty(int(n.sum()), dtype=np.int64)
        cut = np.concatenate(([0], np.cumsum(n)))
        head = np.zeros(len(idx), dtype=bool)
        head[cut[:-1][n > 0]] = True
        idx[head] = fi
        idx[~head] = ri + len(self.firsts.start)
        c = size[idx]
        ends = np.concatenate(([0], np.cumsum(c)))
        shift = start[idx] - ends[:-1]
        flat = np.concatenate((self.firsts.flat, self.units.flat))
        ids = flat[np.repeat(shift, c) + np.arange(int(ends[-1]))] if len(idx) else flat[:0]
        return ids, ends[cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or DEFAULT_DIR}/{name}.tiktoken"
