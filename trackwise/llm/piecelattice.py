"""SentencePiece encoding over a lattice of pieces, many segments at once.

A text becomes its marked form (a leading mark, spaces as marks) and is cut into
segments at places that no piece reaches over, so a text's ids are those of its segments
in order. Every task solves the lattice once for each distinct segment of a batch of rows:
all places meet the pieces that start there (a trie as sorted keys, one search a length, without the pieces
that a split of theirs outscores, which no best path holds), edges are put in order of their
starts, and the path of the greatest score sum is taken (Viterbi; of equal sums the one
that ends in the shortest piece). A character without a piece is an edge ``UNKNOWN``
below the least score and becomes its byte pieces. Documents stay in the task that read them: neither
segments nor ids are shuffled.

For a unigram model these are the library's ids. The public model is a BPE model, whose
library merges greedily instead; its pieces and scores give other, equally decodable ids
here. Time grows with a segment's length; edges are held for ``BLOCK`` starts of a segment at a time,
sums and steps (16 bytes a character) for all of it.

Defined results: null and empty texts have no ids; rows that repeat an id are rows of
their own; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.llm.text import light, slim

MARK = "▁"
UNKNOWN = 10.0
FIRST_BYTE = 3


def pieces(spark: SparkSession, name: str) -> tuple[list[tuple[str, int, float]], int]:
    """The pieces of a model with id and score, without control and byte pieces, and the longest piece's length; their number is fixed by the model."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    rows = [(m.id_to_piece(i), i, float(m.get_score(i))) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return rows, max(len(r[0]) for r in rows)


#: Marks with letters, marks with other signs, marks, single digits, line feeds; else marks with what follows them.
FINE = rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}0-9{MARK}\n]+|{MARK}+|[0-9]|\n"
COARSE = rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n"


def cut_of(table: list[str]) -> str:
    """The pattern of segments for a piece table: the finer one if none of its pieces reaches over its cuts."""
    kind = lambda c: "M" if c == MARK else "L" if c.isalpha() else "D" if c in "0123456789" else "N" if c == "\n" else "P"
    return FINE if all(re.fullmatch("M*L+|M*P+|M+|D|N", "".join(map(kind, p))) for p in table) else COARSE


def segments(text: Column, cut: str = FINE) -> Column:
    """The segments of a text in order."""
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(cut), F.lit(0))).otherwise(F.array().cast("array<string>"))


def used(rows: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """The pieces that a best path can hold: those that no split of theirs into pieces outscores, as the split could always stand in their place."""
    score = {p: s for p, _, s in rows}
    least = min(score.values()) - UNKNOWN

    def outscored(p: str) -> bool:
        best = [0.0]
        for e in range(1, len(p) + 1):
            best.append(max(best[s] + score.get(p[s:e], least if e - s == 1 else float("-inf")) for s in range(e) if e - s < len(p)))
        return best[-1] > score[p]

    return [r for r in rows if len(r[0]) == 1 or not outscored(r[0])]


#: Starts of a segment whose edges are held at once, and characters of segments that are solved together.
BLOCK, STEP = 512, 1 << 18
#: A key of the trie: node * CODES + code point; a step of a path: its length * CODES + id + 1 (0: no piece).
CODES = 1 << 21


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + size - 1`` of many spans, one span after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class Lattice:
    """A piece table as a trie with scores, and the best paths of segments over it."""

    def __init__(self, rows: list[tuple[str, int, float]], longest: int, block: int = BLOCK):
        nodes: dict[int, int] = {}
        ids = [-1]
        for piece, i, _ in used(rows):
            at = 0
            for c in piece:
                at = nodes.setdefault(at * CODES + ord(c), len(ids))
                if at == len(ids):
                    ids.append(-1)
            ids[at] = i
        self.keys = np.array(sorted(nodes), np.int64)
        self.child = np.array([nodes[k] for k in sorted(nodes)], np.int64)
        self.piece, self.longest, self.block = np.array(ids, np.int64), longest, block
        self.score = np.full(max(r[1] for r in rows) + 2, min(r[2] for r in rows) - UNKNOWN)
        self.score[[r[1] + 1 for r in rows]] = [r[2] for r in rows]

    def edges(self, codes: np.ndarray, start: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row length id`` of the edges from ``start`` within ``room`` characters; every single character is one, with id -1 if no piece is."""
        row, node = np.arange(len(start)), np.zeros(len(start), np.int64)
        found = []
        for size in range(1, self.longest + 1):
            key = node * CODES + codes[start[row] + size - 1]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            ids = np.where(hit, self.piece[self.child[spot]], -1)
            real = ids >= 0 if size > 1 else slice(None)
            found.append((row[real], np.full(len(row[real]), size), ids[real]))
            on = hit & (room[row] > size)
            row, node = row[on], self.child[spot][on]
            if not len(row):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def steps(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best paths of segments of ``size`` characters: the places at which their steps end, in order, and these steps.

        Segment k has the places ``codes`` before it + k, for its start, to that + its size.
        """
        order = np.argsort(-size, kind="stable")  # those that reach a level come first
        size, char = size[order], _starts(size)[order]
        first = char + order
        total, took = np.full(len(codes) + len(size), -np.inf), np.zeros(len(codes) + len(size), np.int64)
        total[first] = 0.0
        for low in range(0, int(size.max(initial=0)), self.block):
            wide = np.minimum(size[: np.searchsorted(-size, -low)] - low, self.block)
            seg = np.repeat(np.arange(len(wide)), wide)
            level = low + _spans(np.zeros(len(wide), np.int64), wide)
            row, length, ids = self.edges(codes, char[seg] + level, size[seg] - level)
            key = level[row] * (self.longest + 1) + length
            rank = np.argsort(key, kind="stable")
            row, length, ids, key = row[rank], length[rank], ids[rank], key[rank]
            at, gain, own = first[seg[row]] + level[row], self.score[ids + 1], length * CODES + ids + 1
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                # edges of one start and length have ends of their own; of equal sums the later start stays
                end, reached = at[a:b] + length[a], total[at[a:b]] + gain[a:b]
                better = reached >= total[end]
                total[end[better]], took[end[better]] = reached[better], own[a:b][better]
        ends, at = np.zeros(len(total), bool), first + size
        while True:
            on = at > first
            if not on.any():
                break
            at, first = at[on], first[on]
            ends[at] = True
            at = at - took[at] // CODES
        return np.flatnonzero(ends), took[ends]

    def encoded(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments, one after the other, and their number in each."""
        size = np.array([len(s) for s in segs], np.int64)
        part = np.cumsum(size) // STEP
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(segs)]
        each = [self._encoded(segs[a:b], size[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
        if not each:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*each, strict=True))

    def _encoded(self, segs: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(segs)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        ends, took = self.steps(codes, size)
        seg = np.searchsorted(_starts(size) + np.arange(len(size)), ends) - 1
        ids, char = (took % CODES).astype(np.int32) - 1, ends - seg - 1
        raw = np.frombuffer(text.encode(), np.uint8)
        byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        n = np.where(ids < 0, byte[char + 1] - byte[char], 1)
        out = np.repeat(ids, n)
        bare = np.flatnonzero(ids < 0)  # characters without a piece: their bytes
        out[_spans(_starts(n)[bare], n[bare])] = raw[_spans(byte[char[bare]], n[bare])].astype(np.int32) + FIRST_BYTE
        return out, np.bincount(seg, n, len(size)).astype(np.int64)


def encode_segments(segs: DataFrame, rows: list[tuple[str, int, float]], longest: int, block: int = BLOCK) -> DataFrame:
    """``seg n ids`` for segments ``seg n`` of any length by the pieces ``rows``."""
    lattice = Lattice(rows, longest, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = lattice.encoded(batch.column("seg").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("seg"), batch.column("n"), _lists(ids, n)], ["seg", "n", "ids"])

    return segs.select("seg", "n").mapInArrow(run, f"seg string, n {dict(segs.dtypes)['n']}, ids array<int>")


#: Long segments take the same way as all others.
encode_long = encode_segments


def _lists(values: np.ndarray | pa.Array, size: np.ndarray) -> pa.ListArray:
    """Arrays of ``size`` values each, cut from ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


class Spelling:
    """The bytes of every id."""

    def __init__(self, table: dict[int, bytes]):
        known = [table.get(i, b"") for i in range(max(table) + 1)]
        self.size = np.array([len(b) for b in known], np.int64)
        self.start, self.bytes = _starts(self.size), np.frombuffer(b"".join(known), np.uint8)

    def gives(self, segs: list[str], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ids of each segment, ``n`` of them, decode to it."""
        want = [s.encode() for s in segs]
        size = np.array([len(b) for b in want], np.int64)
        got = np.bincount(np.repeat(np.arange(len(n)), n), self.size[ids], len(n)).astype(np.int64)
        ok = got == size
        spelled, raw = self.bytes[_spans(self.start[ids], self.size[ids])], np.frombuffer(b"".join(want), np.uint8)
        differ = spelled[_spans(_starts(got)[ok], got[ok])] != raw[_spans(_starts(size)[ok], size[ok])]
        ok[np.repeat(np.flatnonzero(ok), size[ok])[differ]] = False
        return ok


def id_bytes(name: str) -> dict[int, bytes]:
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return {i: bytes([i - FIRST_BYTE]) if m.is_byte(i) else m.id_to_piece(i).encode() for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i))}


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", whole: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id n_tokens n_segments ids_digest round_trip`` and, if ``whole``, ``ids``.

    ``ids_digest`` is the sum over segments of a hash of place and the ids' hash, modulo 2**32 a
    segment, so it is order-aware. ``round_trip``: the ids of every segment decode to it.
    """
    light(docs.sparkSession)
    rows, longest = pieces(docs.sparkSession, model)
    lattice, spelling = Lattice(rows, longest), Spelling(id_bytes(model))
    cut_rows = docs.select(F.col(doc_id).alias("doc_id"), segments(F.col(text), cut_of([r[0] for r in rows])).alias("segs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segs = batch.column("segs")
            size = pc.list_value_length(segs).to_numpy(zero_copy_only=False).astype(np.int64)
            told = segs.flatten().dictionary_encode()  # each distinct segment once
            own, place = told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False)
            ids, n = lattice.encoded(own)
            parts = _lists(ids[_spans(_starts(n)[place], n[place])], n[place])
            row = np.repeat(np.arange(len(size)), size)
            tokens = np.bincount(row, n[place], len(size)).astype(np.int64)
            wrong = np.bincount(row, ~spelling.gives(own, ids, n)[place], len(size)) > 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(parts, size), pa.array(tokens), pa.array(~wrong)], ["doc_id", "parts", "n_tokens", "round_trip"])

    coded = cut_rows.mapInArrow(slim(run), f"doc_id {dict(cut_rows.dtypes)['doc_id']}, parts array<array<int>>, n_tokens long, round_trip boolean")
    digest = F.transform("parts", lambda x, i: F.xxhash64(i, F.xxhash64(x)).bitwiseAND(F.lit((1 << 32) - 1)))
    total = F.aggregate(digest, F.lit(0).cast("long"), lambda a, x: a + x)
    return coded.select("doc_id", "n_tokens", F.size("parts").cast("long").alias("n_segments"), total.alias("ids_digest"), "round_trip", *([F.flatten("parts").alias("ids")] if whole else []))
