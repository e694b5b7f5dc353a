"""Language-model scoring by context-tree weighting over bytes.

Training texts (A-Z lower-cased) are counted as runs of ``DEPTH`` context bytes and the
next byte; the end of a text is a byte of its own. All 256 byte values are symbols; a
symbol is eight binary decisions. Each decision has a context tree over the preceding
bytes, in which a node's Krichevsky-Trofimov estimate is mixed with those of all deeper
nodes by context-tree weights. Every context is kept, however rare. Scoring uses the
trained tree as it stands: the log10 probability of a text is the sum over its bytes and
its end.

The tree is a distributed table: subtrees below contexts of ``TOP`` bytes are weighed
where their counts lie, and only the nodes above them (at most 257 contexts of 255
decisions) reach the driver. Texts are scored in runs. The distinct codes (contexts with
the next byte) of a run travel as packed arrays, one for each of ``BUCKETS`` groups of
subtrees; a bucket's arrays are merged one after another, so a task holds the distinct
codes of a bucket, not their occurrences; the answers go back to the runs' texts.
``Tree`` is the same model held in one place, over fewer symbols and with dropped contexts.

Beside it stands a unigram base over words: sum of log10((c + 1) / (N + V + 1)). Words
are known by a 64-bit hash. Words with at least 1/2**20 of the tokens (so at most 2**20
of them) are looked up in a shared table, all rarer words by a join.

Defined results: null texts are empty and score their end only; without training
documents every decision has probability 1/2 and the base counts are zero; rows that
repeat an id are scored as rows of their own; rows without id are held out of nothing
and are trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.llm.bytewords import Words, chunks, distinct, mix
from trackwise.llm.text import cut_lineage, light, slim, written

DEPTH, CLASSES, LEVELS = 5, 64, 6
END = 0xFF
#: Bytes of text worked on at once in a task.
CHUNK = 4_000_000
OTHER = CLASSES - 1
#: Bytes of text that share one list of codes, context bytes of a subtree's root, and groups of subtrees.
GROUP, TOP, BUCKETS = 24_000_000, 2, 1024
WORD_SHARE = 1 << 20
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def byte_run(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, lower-cased; the positions to predict, and where each text's positions start among them."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    pad = bytes([END]) * DEPTH
    buf = _LOW[np.frombuffer(pad + b"".join(p + pad for p in parts), np.uint8)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = DEPTH + np.concatenate([[0], np.cumsum(size + DEPTH)[:-1]]).astype(np.int64)
    use = np.ones(len(buf), bool)
    use[:DEPTH] = False
    for k in range(1, DEPTH):
        use[begin + size + k] = False
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    return buf, np.flatnonzero(use), first


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One ascending list of values and summed counts."""
    value, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(value, kind="stable")
    value, n = value[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, int)
    return value[first], np.add.reduceat(n, first) if len(first) else n


def packed(x: np.ndarray) -> bytes:
    """An array as compressed bytes, its size in front."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd"), dtype)


def packed_codes(code: np.ndarray) -> bytes:
    """Ascending codes, by their steps."""
    return packed(np.diff(code, prepend=0))


def unpacked_codes(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.int64))


def bucket_of(code: np.ndarray) -> np.ndarray:
    """The bucket of a code's newest ``TOP`` context bytes."""
    return (mix(((code >> 8) & ((1 << 8 * TOP) - 1)).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int32)


_RUNS = "run long, rid long, _id long, _text string, _held boolean, bucket int, codes binary, n binary"


def coded_runs(own: DataFrame) -> DataFrame:
    """Texts in runs of about ``GROUP`` bytes, with each run's distinct codes of DEPTH + 1 bytes, written once.

    Rows of a text have ``run rid _id _text _held``, rows of codes ``run bucket codes n``,
    where ``n`` counts the training texts only (0: held-out texts alone have it).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_id = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        group = size = row = 0
        blank = lambda k, kind: pd.array([None] * k, kind)

        def codes(group: int) -> pd.DataFrame:
            code, n = _merged(held)
            held.clear()
            bucket = bucket_of(code)
            order = np.argsort(bucket, kind="stable")
            code, n, bucket = code[order], n[order], bucket[order]
            own, cut = np.unique(bucket, return_index=True)
            ends = np.append(cut[1:], len(code))
            k = len(own)
            return pd.DataFrame({"run": (part_id << 33) + group, "rid": blank(k, "Int64"), "_id": blank(k, "Int64"), "_text": None, "_held": None, "bucket": pd.array(own, "Int32"), "codes": [packed_codes(code[a:b]) for a, b in zip(cut, ends, strict=True)], "n": [packed(n[a:b].astype(np.uint32)) for a, b in zip(cut, ends, strict=True)]})

        for pdf in batches:
            for at, part in chunks(list(pdf["_text"]), CHUNK):
                frame = pdf.iloc[at : at + len(part)]
                buf, use, first = byte_run(part)
                learn = np.repeat(~frame["_held"].to_numpy(bool), np.diff(np.append(first, len(use))))
                code = pack_codes(buf, use)
                for chosen, weight in ((learn, 1), (~learn, 0)):
                    value, n = np.unique(code[chosen], return_counts=True)
                    held.append((value, n * weight))
                if sum(len(v) for v, _ in held) > 3_000_000:
                    held[:] = [_merged(held)]
                k = len(part)
                yield pd.DataFrame({"run": (part_id << 33) + group, "rid": pd.array((part_id << 33) + row + np.arange(k), "Int64"), "_id": pd.array(frame["_id"], "Int64"), "_text": part, "_held": frame["_held"].to_numpy(bool), "bucket": blank(k, "Int32"), "codes": None, "n": None})
                row, size = row + k, size + len(buf)
                if size >= GROUP:
                    yield codes(group)
                    group, size = group + 1, 0
        if held:
            yield codes(group)

    return written(own.mapInPandas(slim(run), _RUNS))


def pack_codes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The DEPTH bytes before each position and its own, oldest highest."""
    code = np.zeros(len(at), np.int64)
    for k in range(DEPTH, -1, -1):
        code = (code << 8) | buf[at - k]
    return code


def word_counts(rows: DataFrame, text: str) -> DataFrame:
    """Counts ``n`` of each word, by hash; the count of texts stands under a null key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs = 0
        for pdf in batches:
            docs += len(pdf)
            for _, part in chunks(list(pdf[text]), 2 * CHUNK):
                h = Words(part, lower=True).hashes().view(np.int64)
                value, n = np.unique(h, return_counts=True)
                yield pd.DataFrame({"key": pd.array(value, "Int64"), "n": n})
        yield pd.DataFrame({"key": pd.array([None], "Int64"), "n": [docs]})

    return rows.select(text).mapInPandas(slim(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series above 8."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - low


def _decisions(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 at the 63 binary decisions, from symbol counts (rows, 64)."""
    zero, one = [], []
    for level in range(LEVELS):
        x = n.reshape(len(n), 1 << level, 2, CLASSES >> (level + 1)).sum(3)
        zero.append(x[:, :, 0])
        one.append(x[:, :, 1])
    return np.concatenate(zero, 1), np.concatenate(one, 1)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


@dataclass
class Tree:
    classes: np.ndarray  # byte -> symbol
    other: np.ndarray  # byte -> log10 probability within the class of all others, else 0
    codes: list  # by depth, the contexts that are nodes
    log10: np.ndarray  # node row -> log10 probability of each symbol
    _child: np.ndarray | None = None

    def child(self) -> np.ndarray:
        """Node row and the symbol before its context -> row of the longer context, or -1 if that is no node."""
        if self._child is None:
            n = sum(map(len, self.codes))
            out = np.full((n, CLASSES), -1, np.int32)
            above, row = np.zeros(1, np.int64), 1
            for d in range(1, len(self.codes)):
                oldest, rest = np.divmod(self.codes[d], CLASSES ** (d - 1))
                at = np.searchsorted(above, rest)
                out[row - len(above) + at, oldest] = np.arange(row, row + len(self.codes[d]))
                above, row = self.codes[d], row + len(self.codes[d])
            self._child = out
        return self._child

    def score(self, texts: list) -> np.ndarray:
        """log10 probability of each text with its end."""
        buf, at, first = byte_run(texts)
        sym = self.classes[buf].astype(np.int32)
        own = sym[at]
        child, row = self.child().ravel(), np.zeros(len(at), np.int32)
        live = np.arange(len(at))
        for d in range(1, len(self.codes)):
            longer = child[row[live] * CLASSES + sym[at[live] - d]]
            live, longer = live[longer >= 0], longer[longer >= 0]
            row[live] = longer
        lp = self.log10.ravel()[row * CLASSES + own].astype(np.float64)
        rare = np.flatnonzero(own == OTHER)
        lp[rare] += self.other[buf[at[rare]]]
        return np.add.reduceat(lp, first) if len(first) else lp


def build_tree(classes: np.ndarray, byte_n: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """Weigh the tree bottom-up, then mix top-down. ``levels``: by depth, node contexts (ascending) and symbol counts (nodes, 64)."""
    log_pe, log_pw, kt = [], [None] * len(levels), []
    for _, n in levels:
        a, b = _decisions(n)
        log_pe.append(_log_kt(a, b))
        kt.append((b + 0.5) / (a + b + 1))
    parents = [None] + [np.searchsorted(levels[d - 1][0], levels[d][0] & ((1 << LEVELS * (d - 1)) - 1)) for d in range(1, len(levels))]
    log_pw[-1] = log_pe[-1]
    rest_kt = [None] * len(levels)
    stop: list = [None] * len(levels)
    for d in range(len(levels) - 2, -1, -1):
        n = levels[d][1]
        left, below = n.copy(), np.zeros_like(log_pe[d])
        np.subtract.at(left, parents[d + 1], levels[d + 1][1])
        np.add.at(below, parents[d + 1], log_pw[d + 1])
        a, b = _decisions(np.maximum(left, 0))
        below += _log_kt(a, b)
        has = np.zeros(len(n), bool)
        has[parents[d + 1]] = True
        log_pw[d] = np.where(has[:, None], np.logaddexp(log_pe[d], below) - np.log(2), log_pe[d])
        stop[d] = np.where(has[:, None], np.exp(log_pe[d] - np.log(2) - log_pw[d]), 1.0)
        rest_kt[d] = (b + 0.5) / (a + b + 1)
    tables = []
    for d, (codes, _) in enumerate(levels):
        # the chain of ancestors, nearest first
        chain, rows = [], np.arange(len(codes))
        for e in range(d, 0, -1):
            rows = parents[e][rows]
            chain.append((e - 1, rows))
        q = kt[d] if stop[d] is None else stop[d] * kt[d] + (1 - stop[d]) * rest_kt[d]
        for e, r in chain:
            w = stop[e][r]
            q = w * kt[e][r] + (1 - w) * q
        lp, at = np.zeros((len(codes), 1)), 0
        for level in range(LEVELS):
            p = q[:, at : at + (1 << level)]
            lp = np.stack([lp + np.log10(1 - p), lp + np.log10(p)], 2).reshape(len(codes), 2 << level)
            at += 1 << level
        tables.append(lp.astype(np.float32))
    rare = classes == OTHER
    other = np.where(rare, np.log10((byte_n + 0.5) / (byte_n[rare].sum() + 0.5 * max(1, rare.sum()))), 0.0)
    return Tree(classes, other, [c for c, _ in levels], np.concatenate(tables))


def subtrees(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """Weigh whole subtrees below contexts of ``TOP`` bytes, from all their codes.

    Gives for each code and each of its eight decisions the probability of its bit by the
    nodes of depth TOP to DEPTH, and per context of TOP bytes and decision the counts and
    log weight ``at decision a b pw``, which the shallower nodes need. A context or
    decision without training counts has log weight 0 and probability 1/2, as in the
    full tree, so that codes of held-out texts are answered by the same table.
    """
    rev = np.zeros(len(code), np.int64)
    for k in range(1, DEPTH + 1):
        rev = (rev << 8) | ((code >> 8 * k) & 255)
    own, up = {}, {}
    last = np.arange(len(code))
    for d in range(DEPTH, TOP - 1, -1):
        own[d], up[d] = np.unique(((rev >> 8 * (DEPTH - d)) << 8) | (code & 255), return_inverse=True)
    count = {d: np.bincount(up[d], n, len(own[d])) for d in own}
    sample = {d: np.zeros(len(own[d]), np.int64) for d in own}
    for d in own:
        sample[d][up[d]] = last
    out, roots = np.empty((len(code), 8), np.float32), []
    bit = lambda x, level: (x >> (7 - level)) & 1
    for level in range(8):
        a, b, pe, pw, node, begin = {}, {}, {}, {}, {}, {}
        for d in own:
            key = own[d] >> (8 - level)
            new = np.append(True, key[1:] != key[:-1])
            begin[d], node[d] = np.flatnonzero(new), np.cumsum(new) - 1
            one = bit(own[d], level)
            a[d], b[d] = (np.add.reduceat(count[d] * (one == v), begin[d]) for v in (0, 1))
            pe[d] = _log_kt(a[d], b[d])
        one = bit(code, level)
        at = node[DEPTH][up[DEPTH]]
        q = (np.where(one, b[DEPTH][at], a[DEPTH][at]) + 0.5) / (a[DEPTH][at] + b[DEPTH][at] + 1)
        pw[DEPTH] = pe[DEPTH]
        for d in range(DEPTH - 1, TOP - 1, -1):
            above = node[d][up[d][sample[d + 1][begin[d + 1]]]]
            pw[d] = np.logaddexp(pe[d], np.bincount(above, pw[d + 1], len(pe[d]))) - np.log(2)
            stop = np.exp(pe[d] - np.log(2) - pw[d])
            at = node[d][up[d]]
            q = stop[at] * (np.where(one, b[d][at], a[d][at]) + 0.5) / (a[d][at] + b[d][at] + 1) + (1 - stop[at]) * q
        out[:, level] = q
        head = own[TOP][begin[TOP]]
        roots.append(pd.DataFrame({"at": head >> 8, "decision": (1 << level) | ((head & 255) >> (8 - level)), "a": a[TOP], "b": b[TOP], "pw": pw[TOP]}))
    return out, pd.concat(roots)


@dataclass
class Top:
    """The nodes of depth 0 and 1, folded: by newest byte, decision and bit, what they add, and the share left to deeper nodes."""

    base: np.ndarray  # (256, 256, 2)
    share: np.ndarray  # (256, 256)

    def log10(self, code: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """log10 probability of each code's last byte, from the probabilities of the deeper nodes."""
        newest, s, lp = (code >> 8) & 255, code & 255, np.zeros(len(code))
        for level in range(8):
            k = (1 << level) | (s >> (8 - level))
            lp += np.log10(self.base[newest, k, (s >> (7 - level)) & 1] + self.share[newest, k] * deep[:, level])
        return lp


def fold_top(roots: pd.DataFrame) -> Top:
    """Weigh the nodes of depth 1 and 0 over ``at decision a b pw``, summed by newest byte: at most 256 * 255 rows."""
    a, b, below = np.zeros((3, 256, 256))
    where = roots["at"].to_numpy(int), roots["decision"].to_numpy(int)
    a[where], b[where], below[where] = roots["a"], roots["b"], roots["pw"]
    kt = lambda a, b: np.stack([a + 0.5, b + 0.5], -1) / (a + b + 1)[..., None]
    pe1 = _log_kt(a, b)
    pw1 = np.logaddexp(pe1, below) - np.log(2)
    pe0 = _log_kt(a.sum(0), b.sum(0))
    pw0 = np.logaddexp(pe0, pw1.sum(0)) - np.log(2)
    stop1, stop0 = np.exp(pe1 - np.log(2) - pw1), np.exp(pe0 - np.log(2) - pw0)
    base = (stop0[:, None] * kt(a.sum(0), b.sum(0)))[None] + ((1 - stop0)[None] * stop1)[..., None] * kt(a, b)
    return Top(base, (1 - stop0)[None] * (1 - stop1))


def _by_bucket(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", *order)


def weighed(blobs: DataFrame) -> DataFrame:
    """Per bucket its merged ``codes n`` (one row), and the roots of its subtrees ``at decision a b pw``; written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(bucket: int) -> Iterator[pd.DataFrame]:
            code, n = _merged(held)
            held.clear()
            none = dict.fromkeys(("at", "decision"), pd.array([None], "Int64")) | dict.fromkeys(("a", "b", "pw"), np.nan)
            yield pd.DataFrame({"bucket": [bucket], "codes": [packed_codes(code)], "n": [packed(n)], **none})
            yield subtrees(code, n.astype(np.float64))[1].assign(bucket=bucket, codes=None, n=None)

        now = None
        for pdf in batches:
            for bucket, codes, n in zip(pdf["bucket"], pdf["codes"], pdf["n"], strict=True):
                if now is not None and bucket != now:
                    yield from done(now)
                now = bucket
                held.append((unpacked_codes(codes), unpacked(n, np.uint32).astype(np.int64)))
                if len(held) > 1 and sum(len(v) for v, _ in held[1:]) > max(1_000_000, len(held[0][0])):
                    held[:] = [_merged(held)]
        if now is not None:
            yield from done(now)

    return written(_by_bucket(blobs.select("bucket", "codes", "n")).mapInPandas(slim(run), "bucket int, codes binary, n binary, at long, decision long, a double, b double, pw double"))


def answered(blobs: DataFrame) -> DataFrame:
    """``asks codes lp``: for the codes of every run and bucket the log10 probabilities of their last bytes, by a tree that keeps every context."""
    nodes = weighed(blobs)
    roots = nodes.filter(F.col("codes").isNull()).groupBy(F.shiftright("at", 8 * (TOP - 1)).alias("at"), "decision").agg(*[F.sum(c).alias(c) for c in ("a", "b", "pw")])
    top = nodes.sparkSession.sparkContext.broadcast(fold_top(roots.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, lp = np.zeros(0, np.int64), np.zeros(0, np.float32)
        for pdf in batches:
            out = []
            for table, asks, codes, n in zip(pdf["table"], pdf["asks"], pdf["codes"], pdf["n"], strict=True):
                if table:  # a bucket's table comes before all that ask it
                    code = unpacked_codes(codes)
                    lp = top.value.log10(code, subtrees(code, unpacked(n, np.int64).astype(np.float64))[0]).astype(np.float32)
                else:
                    out.append((int(asks), codes, packed(lp[np.searchsorted(code, unpacked_codes(codes))])))
            yield pd.DataFrame(out, columns=["asks", "codes", "lp"])

    own = nodes.filter(F.col("codes").isNotNull()).select("bucket", F.lit(True).alias("table"), F.lit(0).cast("long").alias("asks"), "codes", "n")
    asked = blobs.select("bucket", F.lit(False).alias("table"), F.col("run").alias("asks"), "codes", F.lit(None).cast("binary").alias("n"))
    return _by_bucket(own.unionByName(asked).withColumn("_last", ~F.col("table")), "_last").drop("_last").mapInPandas(slim(run), "asks long, codes binary, lp binary")


def _held_out(doc_id: str, mod: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == remainder, F.lit(False))


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mod: int = 7, remainder: int = 2) -> DataFrame:
    """Per row of ``docs``: base counts and scores, the model's log10 probability and bits per byte; see the module."""
    light(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), _held_out(doc_id, mod, remainder).alias("_held"))
    spark = docs.sparkSession
    coded = coded_runs(own)
    texts = coded.filter(F.col("bucket").isNull()).select("run", "rid", "_id", "_text", "_held")
    counted = cut_lineage(word_counts(texts.filter(~F.col("_held")), "_text"))
    total = counted.agg(F.sum("n").alias("n"), F.count("key").alias("v"), F.sum(F.when(F.col("key").isNull(), F.col("n"))).alias("docs")).first()
    n_all, n_ends = int(total["n"] or 0), int(total["docs"] or 0)
    base = np.log10(n_all + int(total["v"]) + (n_ends > 0) + 1)
    words = counted.filter(F.col("key").isNotNull())
    least = max(1.0, n_all / WORD_SHARE)
    top = words.filter(F.col("n") >= least).toPandas().sort_values("key")
    rare = words.filter(F.col("n") < least)
    shared = spark.sparkContext.broadcast((top["key"].to_numpy(np.int64), np.append(top["n"].to_numpy(np.int64), 0)))

    def run(pdf: pd.DataFrame, known_codes: pd.DataFrame) -> pd.DataFrame:
        top_key, top_n = shared.value
        all_codes = np.concatenate([unpacked_codes(x) for x in known_codes["codes"]])
        order = np.argsort(all_codes)
        all_codes, all_lp = all_codes[order], np.concatenate([unpacked(x, np.float32) for x in known_codes["lp"]])[order].astype(np.float64)
        out = []
        for at, part in chunks(list(pdf["_text"]), CHUNK):
            frame = pdf.iloc[at : at + len(part)]
            rid = frame["rid"].to_numpy(np.int64)
            w = Words(part, lower=True)
            every = w.hashes()
            codes, where = distinct(every)
            h = every[where].view(np.int64)
            slot = np.minimum(np.searchsorted(top_key, h), max(len(top_key) - 1, 0))
            hit = top_key[slot] == h if len(top_key) else np.zeros(len(h), bool)
            n = np.where(hit, top_n[slot], 0)
            gain, known = np.log10(n + 1.0)[codes], hit[codes]
            count = np.diff(w.first)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
            buf, use, first = byte_run(part)
            lp = np.add.reduceat(all_lp[np.searchsorted(all_codes, pack_codes(buf, use))], first)
            out.append(pd.DataFrame({"rid": rid, "key": rid * 2 + 1, "tf": 0, "n_tokens": pd.array(count + 1, "Int64"), "n_known": add(known) + int(n_ends > 0), "gain": add(gain) + np.log10(n_ends + 1.0), "score": lp, "n_bytes": w.sizes - 1, "doc_id": pd.array(frame["_id"], "Int64"), "held_out": frame["_held"].to_numpy()}))
            doc = np.repeat(np.arange(len(part)), count)
            left = np.flatnonzero(~known)
            pair, tf = np.unique(doc[left] * (len(h) + 1) + codes[left], return_counts=True)
            d, k = np.divmod(pair, len(h) + 1)
            out.append(pd.DataFrame({"rid": rid[d], "key": h[k], "tf": tf, "n_tokens": pd.array([None] * len(d), "Int64"), "n_known": 0, "gain": 0.0, "score": np.nan, "n_bytes": 0, "doc_id": pd.array([None] * len(d), "Int64"), "held_out": None}))
        return pd.concat(out)

    answers = answered(coded.filter(F.col("bucket").isNotNull()).select("run", "bucket", "codes", "n"))
    found = texts.groupBy("run").cogroup(answers.groupBy("asks")).applyInPandas(run, "rid long, key long, tf long, n_tokens long, n_known long, gain double, score double, n_bytes long, doc_id long, held_out boolean")
    met = found.join(rare.select("key", F.col("n").alias("_c")), "key", "left")
    seen = (F.col("_c").isNotNull() & (F.col("tf") > 0)).cast("long")
    by_doc = met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + seen * F.col("tf")).alias("n_known"),
        F.sum(F.col("gain") + F.when(seen == 1, F.col("tf") * F.log10(F.col("_c") + F.lit(1.0))).otherwise(F.lit(0.0))).alias("gain"),
        F.max(F.nanvl("score", F.lit(None).cast("double"))).alias("score"), F.max("n_bytes").alias("n_bytes"),
    )
    return by_doc.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("gain") - F.col("n_tokens") * F.lit(float(base))).alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
