"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Every document becomes its token ids plus an end id. Whole windows are cut off
documents longer than a window; the remainders of about ``block_windows`` windows, or of
``block_docs`` documents, are one block, and each block is partitioned by multiway
differencing: partial partitions are merged largest spread first, the heaviest slot of
one onto the lightest of the other, which leaves windows of nearly equal size. Whenever
the fullest window exceeds the capacity, the number of windows rises by one and the
block is partitioned anew. Where that would leave more than ``slack`` of the block
empty, as with many remainders of just over half a window, remainders are first cut in
halves and the count starts again. Documents below ``LEAST`` ids go as bundles of
neighbours.

A block never leaves its input partition, so there is no shuffle, memory is bounded by
a block and one batch, and a lost task is repeated with the same result. Sequence ids
are (input partition << 36) + a running number.

Defined results: a null or empty text is the end id alone; rows that repeat an id are
packed as rows of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.llm.bytewords import chunks
from trackwise.llm.text import light, slim
from trackwise.llm.wordbpe import encoder

LEAST = 64


def multiway_difference(sizes: list[int], k: int) -> list[list[int]]:
    """Partition item numbers into ``k`` groups of nearly equal total size.

    A partial partition holds its filled slots only, heaviest first; a slot is an item or
    a node that joins two earlier slots.
    """
    n, left, right = len(sizes), [], []
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, slot_a = heapq.heappop(heap)
        _, _, b, slot_b = heapq.heappop(heap)
        over = len(a) + len(b) - k  # slots in which both partitions hold something
        if over > 0:
            p, q = len(a) - over, len(b) - over
            both = np.arange(n + len(left), n + len(left) + over)
            left += slot_a[p:].tolist()
            right += slot_b[q:][::-1].tolist()
            total, slot = np.concatenate([a[:p], b[:q], a[p:] + b[q:][::-1]]), np.concatenate([slot_a[:p], slot_b[:q], both])
        else:
            total, slot = np.concatenate([a, b]), np.concatenate([slot_a, slot_b])
        order = np.argsort(-total, kind="stable")
        total, slot = total[order], slot[order]
        heapq.heappush(heap, (-int(total[0] - (total[-1] if len(total) == k else 0)), i, total, slot))
    groups = []
    for slot in heap[0][3].tolist() if heap else []:
        group, todo = [], [slot]
        while todo:
            at = todo.pop()
            if at < n:
                group.append(at)
            else:
                todo += [right[at - n], left[at - n]]
        groups.append(group)
    return groups + [[] for _ in range(k - len(groups))]


Piece = tuple[int, int, int]  # document of the block, first id, end id


def _bundled(sizes: list[int]) -> list[list[Piece]]:
    """Items of one document, or of neighbours below ``LEAST`` ids."""
    items: list[list[Piece]] = []
    small: list[Piece] = []
    held = 0
    for i, s in enumerate(sizes):
        if s >= LEAST:
            items.append([(i, 0, s)])
            continue
        small.append((i, 0, s))
        held += s
        if held >= LEAST:
            items.append(small)
            small, held = [], 0
    return [*items, small] if small else items


def _halved(item: list[Piece], most: int) -> list[list[Piece]]:
    """An item in parts of at most ``most`` ids."""
    out: list[list[Piece]] = [[]]
    room = most
    for i, a, b in item:
        while a < b:
            if not room:
                out.append([])
                room = most
            n = min(room, b - a)
            out[-1].append((i, a, a + n))
            a, room = a + n, room - n
    return out


def pack_block(sizes: list[int], capacity: int, slack: float = 0.02) -> list[list[Piece]]:
    """Windows of pieces, none above ``capacity``."""
    least = max(1, -(-sum(sizes) // capacity))
    most, items = capacity, _bundled(sizes)
    while True:
        parts = items if most == capacity else [x for item in items for x in _halved(item, most)]
        weight = [sum(b - a for _, a, b in x) for x in parts]
        k = least
        while k <= least + max(1, int(least * slack)) or most <= 1:
            groups = multiway_difference(weight, k)
            if max(sum(weight[i] for i in g) for g in groups) <= capacity:
                return [[p for i in g for p in parts[i]] for g in groups if g]
            k += 1
        most = max(1, most // 2)


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2,
    capacity: int = 4096, block_windows: int = 192, block_docs: int = 65536, slack: float = 0.02,
) -> DataFrame:
    """One row per piece: ``doc_id start length ids doc_tokens sequence_id offset``; ``ids`` are little-endian 32-bit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        seq = TaskContext.get().partitionId() << 36
        block: list[tuple[object, np.ndarray, int]] = []  # id, all ids, where the remainder starts
        held = 0

        def windows() -> Iterator[list[tuple[object, np.ndarray, int, int]]]:
            for w in pack_block([len(x[1]) - x[2] for x in block], capacity, slack):
                yield [(block[i][0], block[i][1], block[i][2] + a, block[i][2] + b) for i, a, b in w]

        def rows(all_windows) -> pd.DataFrame:
            nonlocal seq
            out = []
            for w in all_windows:
                at = 0
                for d, ids, a, b in w:
                    out.append((d, a, b - a, ids[a:b].tobytes(), len(ids), seq, at))
                    at += b - a
                seq += 1
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for pdf in batches:
            whole = []
            all_ids = (ids for _, part in chunks(list(pdf["_text"])) for ids in encode(part))
            for d, ids in zip(pdf["_id"].astype(object), all_ids, strict=True):
                d = None if pd.isna(d) else int(d)
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                full = len(ids) // capacity * capacity
                whole += [[(d, ids, a, a + capacity)] for a in range(0, full, capacity)]
                if full < len(ids):
                    block.append((d, ids, full))
                    held += len(ids) - full
                    if held >= block_windows * capacity or len(block) >= block_docs:
                        whole += windows()
                        block, held = [], 0
                if len(whole) >= 512:
                    yield rows(whole)
                    whole = []
            if whole:
                yield rows(whole)
        if block:
            yield rows(windows())

    light(docs.sparkSession)
    named = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    return named.mapInPandas(slim(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
