"""Near duplicates by fast similarity sketches, banding and exact verification.

A document is the set of its four-word shingles. Its sketch has ``SIZE`` coordinates and
is filled in rounds: in each of the first ``SIZE`` rounds every shingle is thrown into a
hashed bin with a hashed value, and a bin that is still empty takes the least value
thrown into it; in round ``SIZE + k`` all shingles are thrown into bin k. So every
coordinate is full at the end, after one round for large sets, and two sets agree on a
coordinate with the probability of their Jaccard similarity, the share of agreeing
coordinates being concentrated as that of independent draws (Chernoff bounds).

1. Documents with the same set are one class. The classes' sketches are cut into
   ``BANDS`` bands of ``ROWS`` coordinates; classes with an equal band meet. A pair of
   similarity 0.8 misses all bands with probability (1 - 0.8**4)**32 < 5e-8.
2. Two rounds of leaders: in every bucket of a band the class that stands in the most
   and largest buckets leads, and every other class is held against the leader it meets
   most often; then likewise among the classes left outside of the leaders' components.
   This joins groups of copies at linear cost.
3. Classes of different components that still share a bucket meet in blocks of at most
   ``block`` classes a side, inside a task: first by their sketches (a pair that links agrees
   on fewer than ``LEAST`` coordinates with a probability below 1e-10), then by hashed bitmaps
   of their whole sets, whose bits bound the overlap from above, nearly exactly. No other pairs are emitted.
4. What passes is verified on full sets, by exact intersection of the shingles.

Defined results: texts that are null or without words have the empty set, which links
with nothing; documents with fewer words than a shingle have their whole word sequence
as one shingle; rows that repeat an id are rows of their own; the component id is the
smallest id of the component; rows without id link with nothing, have none and are kept.
Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.llm.bytewords import chunks, mix
from trackwise.llm.graph import components
from trackwise.llm.jaccard import compared, may_link, named_rows, set_hash, shingles, signs, size_band, tiles_of
from trackwise.llm.text import light, slim, written

WORDS = 4
ROWS, BANDS = 4, 32
SIZE = ROWS * BANDS
LEAST = 68
TOGETHER = 2048
_BIN_BITS = SIZE.bit_length() - 1
_ROUND = np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_VALUE = np.uint64((1 << (64 - _BIN_BITS)) - 1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of non-empty sets of hashes, one row of ``SIZE`` 16-bit coordinates each."""
    out = np.zeros((len(sets), SIZE), np.uint16)
    full = np.zeros((len(sets), SIZE), bool)
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for k in range(2 * SIZE):
        if not len(h):
            break
        x = mix(h + _ROUND[k])
        at = (x >> np.uint64(64 - _BIN_BITS)).astype(np.int64) if k < SIZE else np.full(len(h), k - SIZE)
        cell = own * SIZE + at
        fresh = ~full.ravel()[cell]
        least = np.full(full.size, ~np.uint64(0))
        np.minimum.at(least, cell[fresh], x[fresh] & _VALUE)
        got = np.flatnonzero(least != ~np.uint64(0))
        out.ravel()[got] = (mix(least[got] ^ _ROUND[k]) >> np.uint64(48)).astype(np.uint16)
        full.ravel()[got] = True
        todo = ~full.all(1)[own]
        h, own = h[todo], own[todo]
    return out


def _sketched(rows: DataFrame) -> DataFrame:
    """``_id n cls sig`` per row; the empty set has no sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, part in chunks(list(pdf["_text"])):
                sets = list(shingles(part, WORDS))
                for k in range(0, len(sets), TOGETHER):
                    some = sets[k : k + TOGETHER]
                    held = [u for u in some if len(u)]
                    sigs = iter(sketches(held))
                    yield pd.DataFrame({
                        "_id": pdf["_id"].iloc[at + k : at + k + len(some)].array, "_none": pdf["_none"].iloc[at + k : at + k + len(some)].array, "n": [len(u) for u in some],
                        "cls": [set_hash(u) if len(u) else 0 for u in some], "sig": [next(sigs).tobytes() if len(u) else None for u in some],
                    })

    # ids travel without nulls, as pandas would turn a column with nulls into floats
    given = rows.select(F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_none"), "_text")
    made = given.mapInPandas(slim(run), "_id long, _none boolean, n long, cls long, sig binary")
    return made.select(F.when(~F.col("_none"), F.col("_id")).alias("_id"), "n", "cls", "sig")


def _keys(sig: Column) -> Column:
    """The bands of a sketch, hashed with their numbers."""
    width = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(sig, k * width + 1, F.lit(width))))


def _led(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a b``, for each class ``b`` the leader of another component it meets most often; and the rows outside of the components of their buckets' leaders.

    Buckets are reduced before a shuffle, and a large one is joined to its one leader, so no task holds a whole bucket.
    """
    heads = tagged.groupBy("key").agg(F.max(F.struct("weight", "cls", "comp")).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    heads = heads.filter("lo != hi").select("key", F.col("lead.cls").alias("a"), F.col("lead.comp").alias("of"))
    apart = tagged.join(heads, "key").filter(F.col("comp") != F.col("of"))
    times = apart.groupBy(F.col("cls").alias("b"), "a").agg(F.count("*").alias("times"))
    return times.groupBy("b").agg(F.max(F.struct("times", "a"))["a"].alias("a")).select("a", "b"), apart.drop("a", "of")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of sketches agree on enough coordinates."""
    return (x == y).sum(1) >= LEAST


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SIZE)


def _may_link(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Of the pairs ``a, b`` those whose sizes and sketches do not rule a link out."""
    side = lambda s: info.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").filter(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[_alike(_matrix(pdf["sa"]), _matrix(pdf["sb"])), ["a", "b"]]

    return met.select("a", "b", "sa", "sb").mapInPandas(slim(run), "a long, b long")


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """Pairs of classes of different components and fitting sizes that sketches and bitmaps do not rule out, from rows ``tile side cls n comp sig bits``."""

    def whole(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        n, comp, cls, side = (pdf[c].to_numpy(np.int64) for c in ("n", "comp", "cls", "side"))
        tile, sig, bits = pdf["tile"].to_numpy(np.int64), _matrix(pdf["sig"]), pdf["bits"].to_numpy(object)
        start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        left, right, held = [], [], 0

        def bounded() -> pd.DataFrame:
            i, j = np.concatenate(left), np.concatenate(right)
            use = may_link(n[i], bits[i], n[j], bits[j])
            return pd.DataFrame({"a": np.minimum(cls[i], cls[j])[use], "b": np.maximum(cls[i], cls[j])[use]})

        for a, b in zip(start, np.append(start[1:], len(tile)), strict=True):
            for i in range(a, b - 1):
                j = np.arange(i + 1, b)
                j = j[((side[j] != side[i]) | (side[j] == 2)) & (comp[j] != comp[i]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))]
                if len(j) and len(j := j[_alike(sig[j], sig[i])]):
                    left.append(np.full(len(j), i))
                    right.append(j)
                    held += len(j)
                    if held > 20_000:
                        yield bounded()
                        left, right, held = [], [], 0
        if held:
            yield bounded()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            done = held["tile"] != held["tile"].iloc[-1] if len(held) else []
            if len(held) > 2000 and done.any():
                if got := list(whole(held[done])):
                    yield pd.concat(got)
                held = held[~done].reset_index(drop=True)
        if held is not None and len(held) and (got := list(whole(held))):
            yield pd.concat(got)

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInPandas(slim(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = 512) -> DataFrame:
    """Per row of ``docs``: ``doc_id n_shingles component_id kept``; one document of each component is kept, the one of the smallest id."""
    light(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    sets = written(_sketched(rows))
    grouped = sets.filter((F.col("n") > 0) & F.col("_id").isNotNull()).groupBy("cls")
    reps = written(grouped.agg(F.min("_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"), F.max("sig").alias("sig")))
    bands = reps.select("cls", F.explode(_keys(F.col("sig"))).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    live = written(bands.join(shared, "key"))
    weight = live.groupBy("cls").agg(F.sum("m").alias("weight"))
    info = written(reps.join(weight, "cls").select("cls", "n", "rep", "sig", "weight"))

    def tagged(rows_of_buckets: DataFrame, comp: DataFrame | None) -> DataFrame:
        own = info.select("cls", "n", "weight")
        if comp is None:
            own = own.withColumn("comp", F.col("cls"))
        else:
            own = own.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        return written(rows_of_buckets.select("key", "cls").join(own, "cls"))

    def verified(pairs: DataFrame) -> DataFrame:
        return written(compared(written(_may_link(pairs, info)), rows, info, WORDS))

    pairs, _ = _led(tagged(live, None))
    found = verified(written(pairs))
    comp = components(found)
    _, apart = _led(tagged(live, comp))
    pairs, _ = _led(written(apart))
    found = found.union(verified(written(pairs)))
    comp = components(found)
    left = tagged(live, comp).withColumn("band", size_band(F.col("n")))
    tiles = written(tiles_of(left.select("key", "cls", "n", "band", "comp"), block))
    bits = signs(tiles.select("cls").distinct(), rows, info, WORDS).select("cls", "bits")
    tiles = tiles.join(written(info.select("cls", "sig").join(bits, "cls")), "cls")
    met = written(_tile_pairs(tiles))
    comp = components(found.union(written(compared(met, rows, info, WORDS))))
    out = named_rows(sets.select("_id", "n", "cls"), reps.select("cls", "rep", "copies"), comp)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
