"""Homomorphic multiset fingerprints of documents (DataFrame functions only).

A document is the multiset of its units: its paragraphs (``\\n``-split lines) cut
after sentence ends, so that long paragraphs count in parts. Each unit is hashed to a
wide vector, and the vectors are added modulo powers of two. Equality of the sums is
therefore independent of the order of units, and a unit is inserted or deleted by
adding or subtracting its vector (``combine``).

The vector has ``WIDE`` elements modulo 2**32, which carry the equality test, and
``PLANES * 3`` one-bit elements, three to a long in fields modulo 2**20, which carry
the likeness: with n units, ``2 * count - n`` is a sum of random signs, so the squared
distance of two such vectors estimates the size of the multiset difference.

Defined results: null text counts as empty; the empty text has the vector of no units
at all, is like itself by 1.0 and like any non-empty text by 0.0. Rows that repeat an
id are ordered by their text. A table of one row is its own next document. Extra
columns are ignored. Exact likeness of 1.0 is only given to equal vectors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE, PLANES = 4, 32
FIELD = 20
MASK32, MASK_FIELD = (1 << 32) - 1, (1 << FIELD) - 1
#: One bit in each of the three fields of a long.
ONES = 1 | 1 << FIELD | 1 << 2 * FIELD
_VEC = [f"w{i}" for i in range(WIDE)] + [f"p{i}" for i in range(PLANES)]


def units(text: Column) -> Column:
    """The units of a text, none of them empty; their delimiters belong to no unit."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.!?])[ ]+"), lambda x: x != "")


def unit_vector(unit: Column) -> list[Column]:
    """The vector of one unit, by column; every element is hashed from the unit's 64-bit hash and the element's number."""
    h = F.xxhash64(unit)
    wide = [F.xxhash64(h, F.lit(i)).bitwiseAND(F.lit(MASK32)).alias(f"w{i}") for i in range(WIDE)]
    planes = [F.xxhash64(h, F.lit(100 + i)).bitwiseAND(F.lit(ONES)).alias(f"p{i}") for i in range(PLANES)]
    return wide + planes


def multiset_sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per key: ``vec``, an array of the unit count and the summed elements; no units give zeros.

    Every unit becomes a row and the sums are added map-side first, so one very long
    document is no more than a few rows for a shuffle.
    """
    each = rows.select(*keys, F.explode_outer(units(F.col(text))).alias("_u"))
    there = F.col("_u").isNotNull()
    vec = each.select(*keys, there.cast("long").alias("_n"), *[F.when(there, v).otherwise(F.lit(0)).alias(n) for n, v in zip(_VEC, unit_vector(F.col("_u")), strict=True)])
    sums = vec.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(n).alias(n) for n in _VEC])
    return sums.select(*keys, F.array(F.col("_n"), *[F.col(n).bitwiseAND(F.lit(MASK32)) if n[0] == "w" else F.col(n) for n in _VEC]).alias("vec"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector after the units of ``b`` are inserted (sign 1) or deleted (sign -1)."""
    total = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.transform(total, lambda x, i: F.when((i >= 1) & (i <= WIDE), x.bitwiseAND(F.lit(MASK32))).otherwise(x))


def as_text(vec: Column) -> Column:
    """The vector as text, all elements in hexadecimal."""
    return F.array_join(F.transform(vec, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common units, 2|A and B| / (|A| + |B|), of two vectors."""

    def signs(v: Column, i: int) -> list[Column]:
        p = v[1 + WIDE + i]
        return [2 * F.shiftright(p, FIELD * k).bitwiseAND(F.lit(MASK_FIELD)) - v[0] for k in range(3)]

    parts = [(x - y) * (x - y) for i in range(PLANES) for x, y in zip(signs(a, i), signs(b, i), strict=True)]
    apart = reduce(lambda s, v: s + v, parts).cast("double") / F.lit(float(PLANES * 3))
    both = (a[0] + b[0]).cast("double")
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.lit(1.0) - apart / both)))


def _range_of(value: Column, edges: list) -> Column:
    """How many of the sorted ``edges`` are at most ``value``, by bisection."""
    if not edges:
        return F.lit(0)
    all_edges = F.lit(edges)

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_, up = acc["lo"] < acc["hi"], all_edges[mid] <= value
        return F.struct(F.when(open_ & up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(edges).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi")), halve)["lo"]


def in_order(docs: DataFrame, *, buckets: int) -> DataFrame:
    """Rows ``b pos ghost`` + ``_id _text _next_text``: every row with the text of the next one by id (after the last: the first).

    Rows are dealt to ranges of ids; the edges are ids that occur (at most
    ``buckets`` quantiles, held on the driver). The first row of a range is also sent,
    as a ghost, to the end of the range before it, and the first of all to the end of
    the last. So the next row is always in the same range, and no task orders the whole
    table.
    """
    steps = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.min("_id").alias("first"), F.percentile_approx("_id", steps, 20 * buckets).alias("edges")).first()
    edges = sorted({e for e in found["edges"] or [] if e > found["first"]})
    first = docs.filter(F.col("_id").isNull()).limit(1).count() == 0
    at = F.when(F.col("_id").isNull(), F.lit(0)).otherwise(_range_of(F.col("_id"), edges)).cast("int")
    ranged = docs.withColumn("b", at)
    place = lambda b, ghost: F.struct(b.cast("int").alias("b"), F.lit(ghost).alias("ghost"))
    none = F.array().cast("array<struct<b:int,ghost:int>>")
    is_edge = (F.col("b") > 0) & (F.lit(edges)[F.greatest(F.col("b") - 1, F.lit(0))] == F.col("_id")) if edges else F.lit(False)
    is_first = F.col("_id") == F.lit(found["first"]) if first and found["first"] is not None else F.col("_id").isNull()
    places = F.concat(
        F.array(place(F.col("b"), 0)),
        F.when(is_edge, F.array(place(F.col("b") - 1, 1))).otherwise(none),
        F.when(is_first, F.array(place(F.lit(len(edges)), 2))).otherwise(none),
    )
    placed = ranged.select("_id", "_text", F.explode(places).alias("x")).select("_id", "_text", "x.b", "x.ghost")
    order = Window.partitionBy("b").orderBy("ghost", F.col("_id").asc_nulls_first(), F.xxhash64("_text"), "_text")
    return placed.select("b", "ghost", "_id", "_text", F.row_number().over(order).alias("pos"), F.lead("_text").over(order).alias("_next_text"))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see the module.

    The texts are shuffled once, by range of ids; all that follows groups and orders
    within those ranges and needs no further exchange.
    """
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("_text").substr(F.lit(1), n - half), F.col("_next_text").substr(F.lit(1), half))
    led = in_order(own, buckets=buckets).select("b", "pos", "ghost", "_id", n.cast("long").alias("n_chars"), "_text", F.when(F.col("ghost") == 0, edited).alias("_edited"))
    keys = ["b", "pos", "ghost", "_id", "n_chars", "edited_sha256"]
    both = led.select(*keys[:-1], F.sha2("_edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("t")))).alias("x"))
    sums = multiset_sums(both.select(*keys, F.col("x.kind").alias("kind"), F.col("x.t").alias("t")), [*keys, "kind"], "t")
    order = Window.partitionBy("b", "pos", "ghost", "_id", "n_chars").orderBy("kind")
    pairs = sums.withColumn("edited_vec", F.lead("vec").over(order)).filter(F.col("kind") == 0)
    nexts = pairs.withColumn("next_vec", F.lead("vec").over(Window.partitionBy("b").orderBy("pos"))).filter(F.col("ghost") == 0)
    return nexts.select(
        F.col("_id").alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("vec")).alias("fingerprint"), as_text(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"), likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
