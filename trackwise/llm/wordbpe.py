"""Whole texts to the ids of a word-end BPE vocabulary, word by word for many words at once.

Its pre-tokens are runs of letters, single digits and runs of other signs, none of them
across white space. Runs of ASCII and Latin-1 letters, digits and signs are merged here
in numpy, all distinct ones of a buffer together; any other word goes through the
tokenizer itself. Both give the tokenizer's ids (tested).
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from trackwise.llm.bytewords import Words, distinct, mix, ragged

#: Kind of each byte: 0 white space, 1 letter, 2 digit, 3 other, 4 left to the tokenizer (apostrophes, controls, all but ASCII and U+00C0-00FF).
_KIND = np.full(256, 4, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x21:0x7F] = [1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 if b == 0x27 else 3 for b in range(0x21, 0x7F)]
_NONE = np.int32(2**31 - 1)


class WordBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[sign[b] + "</w>"] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        # an open hash table of pairs: slot -> (pair, rank, merged id)
        self.bits = 19
        n = 1 << self.bits
        self.key, self.rank, self.to = np.full(n, -1, np.int64), np.full(n, _NONE, np.int32), np.zeros(n, np.int32)
        self.probes = 1
        todo, slot, tries = np.arange(len(keys)), self._slot(keys), 1
        while len(todo):
            s = (slot[todo] + tries - 1) & (n - 1)
            _, mine = np.unique(s, return_index=True)
            mine = mine[self.key[s[mine]] < 0]
            got = todo[mine]
            self.key[s[mine]], self.rank[s[mine]] = keys[got], got
            self.to[s[mine]] = [vocab[pairs[i][0] + pairs[i][1]] for i in got]
            todo = np.setdiff1d(todo, got)
            self.probes, tries = tries, tries + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; no rank where a pair does not merge."""
        keys = (a.astype(np.int64) << 20) | b
        s = self._slot(keys)
        rank, to = np.full(len(keys), _NONE, np.int32), np.zeros(len(keys), np.int32)
        todo = np.arange(len(keys))
        for t in range(self.probes):
            at = (s[todo] + t) & ((1 << self.bits) - 1)
            hit = self.key[at] == keys[todo]
            rank[todo[hit]], to[todo[hit]] = self.rank[at[hit]], self.to[at[hit]]
            todo = todo[~hit & (self.key[at] >= 0)]
            if not len(todo):
                break
        return rank, to

    def _merge(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row of symbols; rows of results, and how many of each count."""
        n, width = sym.shape
        size = np.full(n, width)
        if width == 1:
            return sym, size
        rank, to = (x.reshape(n, width - 1) for x in self._find(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
        rows = np.arange(n)
        out = sym.copy()
        while len(rows):
            j = rank.argmin(1)
            at = np.arange(len(rows))
            live = rank[at, j] < _NONE
            if not live.all():
                out[rows[~live], : sym.shape[1]] = sym[~live]
                rows, sym, rank, to, j = rows[live], sym[live], rank[live], to[live], j[live]
                at = at[: len(rows)]
                if not len(rows):
                    break
            sym[at, j] = to[at, j]
            size[rows] -= 1
            w = sym.shape[1]
            keep = np.arange(w - 1) + (np.arange(w - 1) > j[:, None])
            sym = np.take_along_axis(sym, keep, 1)
            if w == 2:
                out[rows, :1] = sym
                break
            # the pair right of the merged one goes; its neighbours are looked up again
            drop = np.arange(w - 2) + (np.arange(w - 2) >= j[:, None])
            rank, to = np.take_along_axis(rank, drop, 1), np.take_along_axis(to, drop, 1)
            left = np.flatnonzero(j > 0)
            right = np.flatnonzero(j < w - 2)
            for r, c in ((left, j[left] - 1), (right, j[right])):
                rank[r, c], to[r, c] = self._find(sym[r, c], sym[r, c + 1])
        return out, size

    def _pieces(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of byte runs that are single pre-tokens: flat ids, first, count."""
        flat, first, count, held = [], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), 0
        for width in np.unique(size):
            rows = np.flatnonzero(size == width)
            raw = buf[start[rows][:, None] + np.arange(width)]
            sym = self.inner[raw]
            sym[:, -1] = self.final[raw[:, -1]]
            out, n = self._merge(sym)
            flat.append(out[np.arange(width) < n[:, None]])
            count[rows] = n
            first[rows] = held + np.cumsum(n) - n
            held += int(n.sum())
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), first, count

    def _pretokens(self, w: Words) -> np.ndarray:
        """Lower-case ``w.buf``, cut its words into pre-tokens in place, and tell which of them need the tokenizer."""
        buf = w.buf.copy()
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        tail = buf[lead + 1]
        buf[lead + 1] = np.where((tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97), tail + 0x20, tail)
        kind = _KIND[buf]
        kind[lead] = kind[lead + 1] = np.where((tail == 0x97) | (tail == 0xB7), 3, 1)
        bad = np.concatenate([[0], np.cumsum(kind == 4, dtype=np.int32)])
        odd = np.flatnonzero(bad[w.end] > bad[w.start])
        turn = np.zeros(len(kind) + 1, np.int8)
        turn[w.start[odd]] += 1
        turn[w.end[odd]] -= 1
        kind[np.cumsum(turn[:-1], dtype=np.int8) > 0] = 4
        last = len(kind) - 8
        fresh = np.empty(last + 1, bool)
        fresh[0] = False
        np.not_equal(kind[1 : last + 1], kind[:last], out=fresh[1:])
        fresh |= kind[: last + 1] == 2
        cut = np.flatnonzero(fresh)
        cut = np.concatenate([[0], cut]) if kind[0] and (not len(cut) or cut[0]) else cut
        own = kind[cut]
        there = np.flatnonzero(own > 0)
        stop = np.append(cut[1:], last)
        ends = np.cumsum(w.sizes)
        w.buf, w.start, w.end = buf, cut[there], stop[there]
        w.first = np.concatenate([[0], np.searchsorted(w.start, ends)])
        return own[there] == 4

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of each text."""
        w = Words(texts, lower=True)
        needs = self._pretokens(w)
        codes, at = distinct(w.hashes())
        size = (w.end - w.start)[at]
        slow = needs[at] | (size > 60)
        easy, hard = np.flatnonzero(~slow), np.flatnonzero(slow)
        first, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        ids, first[easy], count[easy] = self._pieces(w.buf, w.start[at[easy]], size[easy])
        more, held = [ids], len(ids)
        for k, i in zip(hard, at[hard], strict=True):
            e = np.asarray(self.tok.encode(w.of(i).decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, np.int32)
            first[k], count[k] = held, len(e)
            held += len(e)
            more.append(e)
        flat, ends = ragged(np.concatenate(more), first, count, codes)
        cuts = np.concatenate([[0], ends])[w.first]
        flat = flat.astype("<u4")
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(name: str) -> WordBpe:
    """The encoder of a public vocabulary file, one for each Python worker."""
    import public_tokenizers

    return WordBpe(public_tokenizers.path(name))
