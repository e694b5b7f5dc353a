"""Exact Jaccard join of word n-grams, and the classes of linked documents.

A document is the set of its five-word shingles, by 64-bit hash. Two sets link when
100 * common >= 80 * union. The work is cut so that no step forms all pairs of a group:

1. Documents with the same set are one class; only classes are compared.
2. Two sets that link share SHARED of their first n // 5 + SHARED shingles (fewer for
   small sets) in any fixed order of all shingles. The order puts shingles that are
   frequent in a bounded sample last (this decides cost only, never the result), so
   shared passages seldom stand among the first. Shingles held by one class are dropped.
3. In every (shingle, size band) the class leads that shares the largest part of its first
   shingles, as the source of a group of copies does. Every other class is compared with
   the one leader it meets most often, by parity sketches, then exactly. This joins groups
   of near copies at linear cost.
4. What is left are classes that share one of their first n // 5 + 1 shingles (sets that
   link share one of these) but no component. They meet in size-banded tiles: classes of
   one band and the next, in blocks of at most ``block`` classes a side. A tile's rows carry
   their sketches, so that only pairs leave a tile whose sizes and sketches leave a link
   possible, and these are compared exactly.

A parity sketch has a bit for the parity of the elements hashed to it, so two sketches differ
in no more bits than their sets in elements: the bound never loses a link.

The exact comparison intersects sorted shingle arrays. Texts are shorter than their arrays, so
the texts of the compared classes travel, once for each group of FAN comparisons with a leader.

Defined results: texts that are null or without words have the empty set, which links
with nothing; documents with fewer words than a shingle have their whole word sequence
as one shingle; rows that repeat an id are rows of their own; the component id is the
smallest id of the component; rows without id link with nothing and have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.llm.bytewords import Words, chunks, mix
from trackwise.llm.graph import components
from trackwise.llm.text import light, slim, written

WORDS = 5
SHARED = 16
FAN = 256
BITMAP, MAX_BITMAP = 2048, 1 << 17
PARITY = 512
FILTER_BITS = 1 << 26
SAMPLE_DOCS, SAMPLE_SHARE, MAX_HOT = 32768, 4096, 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``size`` words."""
    w = Words(texts, lower=True)
    h = w.hashes()
    n = len(h)
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        full = full * _P + h[k : k + len(full)]
    full = mix(full)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            s = np.array([b - a], np.uint64)
            for x in h[a:b]:
                s = s * _P + x
            yield mix(s)
        else:
            yield np.zeros(0, np.uint64)


def set_hash(u: np.ndarray) -> int:
    """A hash of a whole set."""
    with np.errstate(over="ignore"):
        s = mix(u + _P).sum(dtype=np.uint64) + np.uint64(len(u)) * _P
        return int(mix(np.array([s ^ np.bitwise_xor.reduce(mix(u * _P + np.uint64(7)))]))[0].view(np.int64))


def bitmap(u: np.ndarray) -> bytes:
    """Hashed bits of a set: a power of two of them, twice the set's size or more, within fixed limits."""
    width = BITMAP
    while width < 2 * len(u) and width < MAX_BITMAP:
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(u % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def parity(u: np.ndarray) -> bytes:
    """The parities of a set's elements over hashed bits: a power of two of them, the set's size or more."""
    width = PARITY
    while width < len(u):
        width *= 2
    at = (mix(u ^ _P) % np.uint64(width)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1).tobytes()


class Parities:
    """Sketches of ``parity`` with the sizes ``n`` of their sets."""

    def __init__(self, n: np.ndarray, sketches: list[bytes]):
        self.n, self.wide = n, np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.place, self.of = np.zeros(len(n), np.int64), {}
        for w in np.unique(self.wide):
            at = np.flatnonzero(self.wide == w)
            self.place[at] = np.arange(len(at))
            self.of[w] = np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), w // 8)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes and sketches leave a link of the sets ``i`` and ``j`` possible; the wider sketch is folded onto the narrower."""
        out = 5 * np.minimum(self.n[i], self.n[j]) >= 4 * np.maximum(self.n[i], self.n[j])
        todo = np.flatnonzero(out)
        kind = self.wide[i[todo]] * (1 << 32) + self.wide[j[todo]]
        for k in np.unique(kind):
            x, y, at = k >> 32, k & 0xFFFFFFFF, todo[kind == k]
            w = min(x, y) // 8
            step = max(1, 1_000_000 // (max(x, y) // 8))
            for s in range(0, len(at), step):
                part = at[s : s + step]
                p, q = (np.bitwise_xor.reduce(self.of[z][self.place[r[part]]].reshape(len(part), -1, w), 1) for z, r in ((x, i), (y, j)))
                apart = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
                out[part] = 9 * apart <= self.n[i[part]] + self.n[j[part]]
        return out


def shared_least(n):
    """How many of their first shingles two sets that link share at least, for the smaller of their values."""
    return np.minimum(SHARED, n - n // 5)


def in_order(u: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles that stand first: not hot before hot, by hash."""
    n = len(u) // 5 + shared_least(len(u))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
        is_hot = hot[at] == u
        u = np.concatenate([u[~is_hot], u[is_hot]])
    return u[:n]


def links(common: Column, a: Column, b: Column) -> Column:
    return 100 * common >= 80 * (a + b - common)


def _hot(rows: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles that a 1 / SAMPLE_SHARE share of about SAMPLE_DOCS documents hold, at most MAX_HOT.

    A document counts the shingles that may stand among its first: twice as many as do.
    """
    share = min(1.0, SAMPLE_DOCS / max(n_docs, 1))
    some = rows.filter(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in chunks(list(pdf["_text"])):
                key, n = np.unique(np.concatenate([u[: 2 * (len(u) // 5 + shared_least(len(u)))] for u in shingles(part)]), return_counts=True)
                yield pd.DataFrame({"key": key.view(np.int64), "n": n})

    least = max(8, SAMPLE_DOCS // SAMPLE_SHARE)
    found = some.mapInPandas(slim(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(found.orderBy(F.desc("n"), "key").limit(MAX_HOT).toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def _sets(rows: DataFrame) -> DataFrame:
    """``_id n cls sketch`` per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, part in chunks(list(pdf["_text"])):
                out = [(len(u), set_hash(u), parity(u)) if len(u) else (0, 0, b"") for u in shingles(part)]
                frame = pd.DataFrame(out, columns=["n", "cls", "sketch"])
                frame.insert(0, "_id", pdf["_id"].iloc[at : at + len(part)].array)
                yield frame

    return rows.mapInPandas(slim(run), "_id long, n long, cls long, sketch binary")


def _first(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """``key cls core``: the first shingles of each class, once a task however many copies it reads; ``core``: it is one of the first n // 5 + 1."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            for _, part in chunks(list(pdf["_text"])):
                keys, own, cores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for u in shingles(part):
                    if len(u) and (c := set_hash(u)) not in seen:
                        seen.add(c)
                        keys.append(in_order(u, shared.value).view(np.int64))
                        own.append(np.full(len(keys[-1]), c))
                        cores.append(np.arange(len(keys[-1])) <= len(u) // 5)
                key, cls, core = np.concatenate(keys), np.concatenate(own), np.concatenate(cores)
                for at in range(0, len(key), 200_000):
                    yield pd.DataFrame({"key": key[at : at + 200_000], "cls": cls[at : at + 200_000], "core": core[at : at + 200_000]})

    return rows.filter(F.col("_id").isNotNull()).select("_text").mapInPandas(slim(run), "key long, cls long, core boolean")


def _members(first: DataFrame) -> DataFrame:
    """The distinct rows of keys that several classes hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cls, core, told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), False
        for pdf in batches:
            # the last row of the batch before stands in front, as it may be of the same key
            key, cls, core = np.concatenate([key, pdf["key"].to_numpy(np.int64)]), np.concatenate([cls, pdf["cls"].to_numpy(np.int64)]), np.concatenate([core, pdf["core"].to_numpy(bool)])
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
            key, cls, core = key[new], cls[new], core[new]
            same = key[1:] == key[:-1]
            held = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            last_told = bool(held[-1]) or (told and len(key) == 1)
            if told:
                held[0] = False
            yield pd.DataFrame({"key": key[held], "cls": cls[held], "core": core[held]})
            key, cls, core, told = key[-1:], cls[-1:], core[-1:], last_told

    return first.repartition("key").sortWithinPartitions("key", "cls").mapInPandas(slim(run), "key long, cls long, core boolean")


def _led(tagged: DataFrame, order: Column) -> DataFrame:
    """``a b``: for each class ``b`` the leader of another component it meets over the most keys, from ``key cls n comp``.

    The class least in ``order`` leads a key and size band.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = None
        for pdf in batches:
            key, band, cls, comp = (pdf[c].to_numpy(np.int64) for c in ("key", "band", "cls", "comp"))
            if lead is not None:
                key, band, cls, comp = (np.concatenate([[x], y]) for x, y in zip(lead, (key, band, cls, comp), strict=True))
            if not len(key):
                continue
            start = np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])])
            at = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
            use = comp != comp[at]
            pairs, times = np.unique(np.stack([cls[at][use], cls[use]], 1), axis=0, return_counts=True)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "times": times})
            lead = tuple(int(x[at[-1]]) for x in (key, band, cls, comp))

    rows = tagged.select("key", size_band(F.col("n")).alias("band"), "cls", "comp", order.alias("_order"))
    met = rows.repartition("key").sortWithinPartitions("key", "band", "_order", "cls").select("key", "band", "cls", "comp").mapInPandas(slim(run), "a long, b long, times long")
    counted = met.groupBy("b", "a").agg(F.sum("times").alias("times"))
    return counted.groupBy("b").agg(F.max(F.struct("times", "a"))["a"].alias("a")).select("a", "b")


def _slot(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS)) + 1


def _key_filter(keys: DataFrame, name: str) -> np.ndarray:
    """A bit array of fixed size with the hashes of all keys; it may let others pass."""
    slot = _slot(F.col(name))
    parts = keys.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (r["b"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether slots (from 1) are set."""
    at = slots - 1
    return (bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0


def _may_be_in(col: Column, shared) -> Column:
    """A pandas expression over the xxhash64 slots of a column."""

    @F.pandas_udf("boolean")
    def ask(slots: pd.Series) -> pd.Series:
        return pd.Series(_passes(shared.value, slots.to_numpy(np.int64)))

    return ask(_slot(col))


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (``_id`` and others) with the texts of their ids; rows not wanted are left out before the shuffle."""
    bits = rows.sparkSession.sparkContext.broadcast(_key_filter(wanted, "_id"))
    return rows.filter(F.col("_id").isNotNull() & _may_be_in(F.col("_id"), bits)).join(wanted, "_id")


def compared(pairs: DataFrame, rows: DataFrame, info: DataFrame, size: int = WORDS) -> DataFrame:
    """Of the class pairs ``a, b`` those that link, by exact intersection of their sorted arrays.

    Pairs of one ``a`` are dealt to groups of about FAN; the text of ``a`` comes first in each.
    """
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    dealt = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(5)), F.col("fans")).alias("fan"))
    roles = dealt.select("a", "fan", F.col("b").alias("cls"), F.lit(1).alias("role")).union(dealt.select("a", "fan", F.col("a").alias("cls"), F.lit(0).alias("role")).distinct())
    wanted = written(roles.join(info.select("cls", F.col("rep").alias("_id")), "cls").select("_id", "cls", "a", "fan", "role"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead, whose = None, None
        for pdf in batches:
            for at, part in chunks(list(pdf["_text"]), 4_000_000):
                rest = pdf.iloc[at : at + len(part)]
                out = []
                for u, a, fan, cls, role in zip(shingles(part, size), rest["a"], rest["fan"], rest["cls"], rest["role"], strict=True):
                    if not len(u) or set_hash(u) != cls:  # another text of a repeated id
                        continue
                    if role == 0:
                        lead, whose = u, (a, fan)
                    elif whose == (a, fan):
                        both = np.sort(np.concatenate([lead, u]), kind="stable")
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= 80 * (len(lead) + len(u) - common):
                            out.append((a, cls))
                yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    met = _texts(rows, wanted).repartition("a", "fan").sortWithinPartitions("a", "fan", "role")
    return met.mapInPandas(slim(meet), "a long, b long").distinct()


def signs(held: DataFrame, rows: DataFrame, info: DataFrame, size: int = WORDS) -> DataFrame:
    """``cls n bits`` of the classes ``held``."""
    wanted = written(held.join(info, "cls").select("cls", F.col("rep").alias("_id")))
    bits = rows.sparkSession.sparkContext.broadcast(_key_filter(wanted, "_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wanted_texts = pdf["_text"][_passes(bits.value, pdf["_slot"].to_numpy(np.int64))]
            for _, part in chunks(list(wanted_texts)):
                yield pd.DataFrame([(set_hash(u), len(u), bitmap(u)) for u in shingles(part, size) if len(u)], columns=["cls", "n", "bits"])

    # bitmaps are made before the shuffle, as they are smaller than texts
    made = rows.filter(F.col("_id").isNotNull()).select("_text", _slot(F.col("_id")).alias("_slot")).mapInPandas(slim(run), "cls long, n long, bits binary")
    return written(made.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))


def may_link(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and bitmaps (arrays of bytes) leave a link possible: a bit that only one set has stands for an element the other lacks.

    The wider of two bitmaps is folded onto the narrower.
    """
    out = np.zeros(len(n), bool)
    if not len(n):
        return out
    wide = np.stack([np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y)], 1)
    for wx, wy in np.unique(wide, axis=0):
        at = np.flatnonzero((wide[:, 0] == wx) & (wide[:, 1] == wy))
        w = min(wx, wy) // 8
        step = max(1, 4_000_000 // w)
        for k in range(0, len(at), step):
            i = at[k : k + step]
            p, q = (np.bitwise_or.reduce(np.frombuffer(b"".join(z[i]), np.uint64).reshape(len(i), -1, w), 1) for z in (x, y))
            most = np.minimum(n[i] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), m[i] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
            out[i] = 100 * most >= 80 * (n[i] + m[i] - most)
    return out


def _bounded(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Of the pairs ``a, b`` those that sizes and sketches do not rule out."""
    side = lambda s: info.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            both = Parities(np.concatenate([pdf["na"].to_numpy(np.int64), pdf["nb"].to_numpy(np.int64)]), [*pdf["sa"], *pdf["sb"]])
            yield pdf.loc[both.may_link(np.arange(m), np.arange(m, 2 * m)), ["a", "b"]]

    return met.mapInPandas(slim(check), "a long, b long")


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """Pairs of classes of different components that sizes and sketches do not rule out, from rows ``tile side cls n comp sketch`` of tiles."""

    def whole(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """All tiles of a frame sorted by tile; tiles of the same size are worked on together, in runs of bounded size."""
        n, comp, cls, side = (pdf[c].to_numpy(np.int64) for c in ("n", "comp", "cls", "side"))
        sketched = Parities(n, list(pdf["sketch"]))
        tile = pdf["tile"].to_numpy(np.int64)
        start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        size = np.diff(np.append(start, len(tile)))
        got, held = [np.zeros((0, 2), np.int64)], 0
        for m in np.unique(size[size > 1]):
            up, right = np.triu_indices(m, 1)
            first = start[size == m]
            step = max(1, 200_000 // len(up))
            for at in range(0, len(first), step):
                f = first[at : at + step, None]
                i, j = (f + up).ravel(), (f + right).ravel()
                use = ((side[i] != side[j]) | (side[i] == 2)) & (comp[i] != comp[j])
                i, j = i[use], j[use]
                use = sketched.may_link(i, j)
                i, j = cls[i[use]], cls[j[use]]
                got.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))
                held += len(got[-1])
                if held > 200_000:
                    got = [np.unique(np.concatenate(got), axis=0)]
                    held = len(got[0])
                    if held > 100_000:
                        yield pd.DataFrame(got[0], columns=["a", "b"])
                        got, held = [np.zeros((0, 2), np.int64)], 0
        yield pd.DataFrame(np.unique(np.concatenate(got), axis=0), columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            done = held["tile"] != held["tile"].iloc[-1] if len(held) else []
            if len(held) > 4000 and done.any():
                yield from whole(held[done])
                held = held[~done].reset_index(drop=True)
        if held is not None and len(held):
            yield from whole(held)

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInPandas(slim(run), "a long, b long").distinct()


def tiles_of(tagged: DataFrame, block: int) -> DataFrame:
    """Rows ``tile side cls n comp`` of every tile a class stands in, from ``key cls n comp band``.

    A key of at most ``block`` classes is one tile. Otherwise tiles are pairs of blocks
    within a band, and pairs of a block of a band with a block of the next. Tiles of
    one component are left out. Side 0 meets side 1; in side 2 all meet.
    """
    w = Window.partitionBy("key").orderBy("band")
    every = Window.partitionBy("key")
    bands = tagged.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
    bands = bands.withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    beside = lambda f, d: F.when(f("band").over(w) == F.col("band") + d, f(F.struct("blocks", "lo", "hi")).over(w))
    bands = bands.withColumn("up", beside(F.lead, 1)).withColumn("down", beside(F.lag, -1)).withColumn("all", F.sum("m").over(every))
    bands = bands.withColumn("mixed", F.min("lo").over(every) != F.max("hi").over(every)).filter("mixed")
    mixes = lambda other: F.least("lo", f"{other}.lo") != F.greatest("hi", f"{other}.hi")
    with_next = lambda other: F.coalesce(F.when(mixes(other), F.col(f"{other}.blocks")), F.lit(0))
    bands = bands.select("key", "band", "all", F.when(F.col("lo") != F.col("hi"), F.col("blocks")).otherwise(0).alias("within"), "blocks", with_next("up").alias("up"), with_next("down").alias("down"))
    rest = tagged.join(bands, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))

    spot = lambda kind, t, i, j, side: F.struct(F.lit(kind).alias("kind"), t.alias("t"), i.alias("i"), j.alias("j"), side.alias("side"))
    zero = F.lit(0)

    def each(count: str, body) -> Column:
        """One spot for every block of ``count``."""
        return F.transform(F.filter(F.sequence(zero, F.col(count)), lambda k: k < F.col(count)), body)

    within = each("within", lambda k: spot(1, F.col("band"), F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.when(k == F.col("own"), 2).when(F.col("own") < k, 0).otherwise(1)))
    lower = each("up", lambda k: spot(2, F.col("band"), F.col("own"), k, zero))
    upper = each("down", lambda k: spot(2, F.col("band") - 1, k, F.col("own"), F.lit(1)))
    spots = F.when(F.col("all") <= block, F.array(spot(0, zero, zero, zero, F.lit(2)))).otherwise(F.concat(within, lower, upper))
    spread = rest.select("key", "cls", "n", "comp", F.explode(spots).alias("s"))
    return spread.select(F.xxhash64("key", "s.kind", "s.t", "s.i", "s.j").alias("tile"), F.col("s.side").cast("long").alias("side"), "cls", "n", "comp")


def size_band(n: Column) -> Column:
    """Sizes that can link are of one band or of neighbours."""
    return F.floor(F.log(n.cast("double")) / float(np.log(1.25)) + 1e-9).cast("int")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = 512) -> DataFrame:
    """Per row of ``docs``: ``doc_id n_shingles component_id``."""
    light(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    sets = written(_sets(rows))
    hot = _hot(rows, sets.count())
    reps = sets.filter((F.col("n") > 0) & F.col("_id").isNotNull()).groupBy("cls").agg(F.min("_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.count("*").alias("copies"))
    members = written(_members(_first(rows, hot)))
    firsts = (F.floor(F.col("n") / 5) + F.least(F.lit(SHARED), F.col("n") - F.floor(F.col("n") / 5))).cast("double")
    held = members.groupBy("cls").agg(F.count("*").alias("k"))
    info = written(held.join(reps, "cls").select("cls", "n", "rep", "sketch", (F.col("k") / firsts).alias("part")))

    def tag(comp: DataFrame | None) -> DataFrame:
        known = info.withColumn("comp", F.col("cls")) if comp is None else info.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        return members.join(known.select("cls", "n", "part", "comp"), "cls")

    led = written(_led(tag(None), -F.col("part")))
    found = written(compared(written(_bounded(led, info)), rows, info))
    comp = components(found)
    tagged = written(tag(comp).filter("core").withColumn("band", size_band(F.col("n"))).select("key", "cls", "n", "band", "comp"))
    met = written(_tile_pairs(tiles_of(tagged, block).join(info.select("cls", "sketch"), "cls")))
    comp = components(found.union(written(compared(met, rows, info))))
    return named_rows(sets, reps, comp)


def named_rows(sets: DataFrame, reps: DataFrame, comp: DataFrame) -> DataFrame:
    """``doc_id n_shingles component_id`` of all rows (``_id n cls``) from the classes' smallest ids and copies and their components."""
    linked = comp.withColumnRenamed("node", "cls")
    named = reps.join(linked, "cls", "left").filter((F.col("copies") > 1) | F.col("comp").isNotNull()).withColumn("comp", F.coalesce("comp", "cls"))
    named = written(named.select("cls", "rep", "comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = written(named.join(least, "comp").select("cls", "component_id"))
    out = sets.select("_id", "n", "cls").join(of_class, "cls", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("_id").isNotNull(), F.col("component_id")), F.col("_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, and those without id; columns unchanged, whatever their names.

    Rows that repeat an id stay or go together; empty texts are linked with nothing and stay; an empty table stays empty.
    """
    gone = classes(docs, doc_id=doc_id, text=text).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone"))
    own = docs.select(F.struct("*").alias("_row"), F.col(doc_id).cast("long").alias("_id"))
    return own.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
