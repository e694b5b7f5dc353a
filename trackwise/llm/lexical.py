"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length only, ``m = 100 - 75 + (75 * n * N) div L``,
so documents of equal m form a stratum. Inside a stratum the impact of a posting,
``(10**9 * tf) div (1000 * tf + 8 * m)``, depends on tf only: postings are kept by tf and
the impact is computed once per run of equal tf. The largest tf of each term bounds what
any document of the stratum can score for an item.

The index is a table with one row per segment: a stratum, or a part of one where it holds
more than ``SEGMENT_WORDS`` words or ``SEGMENT_DOCS`` documents, so that no length, however
common, is one task's work. Every document is in it, with all its terms.

A search takes items in batches of about ``BATCH_TERMS`` terms, which is what is sent to every task,
and for each batch

1. bounds all segments for all items, from the terms and their largest tf alone;
2. visits for each item the segments with the highest bounds that hold ``k`` documents, which
   gives a score that the k-th best reaches at least;
3. visits, highest bound first, every segment whose bound reaches that score, which rises with what is found.

A segment is left out only where its bound is below the score that k documents reach, so
the result is exact. Equal scores are ordered by ascending id.

Defined results: null texts have no terms; documents without terms count in no statistic;
items without a match give no rows; rows that repeat an item id are one item with the
terms of all; rows that repeat a document id rank each on its own; documents without id
come last among equal scores. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwise.llm.bytewords import chunks
from trackwise.llm.text import light, slim, written

#: Fixed value: what a term is made of (ASCII letters and digits, and everything beyond ASCII).
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SEGMENT_WORDS, SEGMENT_DOCS = 1 << 19, 8192
BATCH_TERMS = 200_000
ITEM_BLOCK = 256
BROADCAST_ROWS = 1 << 20
_SEGMENT = "m long, block long, n_docs long, ids array<long>, terms array<string>, held array<long>, top array<long>, runs array<long>, tf array<long>, size array<long>, docs array<int>"
_BEST = "item int, score long, doc_id long"


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, only A-Z in lower case."""
    if not isinstance(text, str):
        return []
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _rows(df: DataFrame, name: str, text: str) -> DataFrame:
    """``_id _none _text``: ids without nulls, as pandas would turn a column with nulls into floats."""
    i = F.col(name).cast("long")
    return df.select(F.coalesce(i, F.lit(0)).alias("_id"), i.isNull().alias("_none"), F.col(text).alias("_text"))


def _counted(rows: DataFrame) -> DataFrame:
    """``_id _none n terms tfs`` of every row ``_id _none _text``: its distinct terms and how often each occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, part in chunks(list(pdf["_text"])):
                found = [Counter(terms_of(t)) for t in part]
                yield pd.DataFrame({
                    "_id": pdf["_id"].iloc[at : at + len(part)].array, "_none": pdf["_none"].iloc[at : at + len(part)].array, "n": [sum(c.values()) for c in found],
                    "terms": [list(c) for c in found], "tfs": [list(c.values()) for c in found],
                })

    return rows.mapInPandas(slim(run), "_id long, _none boolean, n long, terms array<string>, tfs array<long>")


def impact(tf, m):
    """What a term that occurs tf times gives in a document of normaliser m, in whole numbers."""
    return (10**9 * tf) // (1000 * tf + 8 * m)


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """One index row from the documents of a segment."""
    pdf = pdf.sort_values(["_none", "_id"])
    per_doc = np.fromiter(map(len, pdf["terms"]), np.int64, len(pdf))
    doc = np.repeat(np.arange(len(pdf)), per_doc)
    tf = np.concatenate(list(pdf["tfs"])).astype(np.int64)
    code, terms = pd.factorize(np.concatenate(list(pdf["terms"])), sort=True)
    order = np.lexsort((doc, tf, code))
    code, tf, doc = code[order], tf[order], doc[order]
    new_term = np.concatenate([[True], code[1:] != code[:-1]])
    run = np.flatnonzero(new_term | np.concatenate([[True], tf[1:] != tf[:-1]]))
    term_at = np.flatnonzero(new_term)
    last = np.append(term_at[1:], len(code)) - 1
    return pd.DataFrame({
        "m": [pdf["m"].iloc[0]], "block": [pdf["block"].iloc[0]], "n_docs": [len(pdf)], "ids": [pdf["_id"][~pdf["_none"]].to_numpy()], "terms": [list(terms)],
        "held": [last - term_at + 1], "top": [tf[last]], "runs": [np.bincount(code[run], minlength=len(terms))],
        "tf": [tf[run]], "size": [np.diff(np.append(run, len(code)))], "docs": [doc.astype(np.int32)],
    })


class Index:
    """A written index: ``segments``, with the number of documents that have terms and the number of all their terms."""

    def __init__(self, segments: DataFrame, n_docs: int, n_terms: int):
        self.segments, self.n_docs, self.n_terms = segments, n_docs, n_terms


def build(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows of ``docs``."""
    light(docs.sparkSession)
    counted = written(_counted(_rows(docs, doc_id, text)).filter("n > 0").withColumn("_row", F.monotonically_increasing_id()))
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # decimals, as the product outgrows a long on large corpora
    m = F.expr(f"25 + (cast(75 * n as decimal(19,0)) * cast({n_docs} as decimal(18,0))) div cast({max(n_terms, 1)} as decimal(19,0))").cast("long")
    strata = counted.groupBy(m.alias("m")).agg(F.sum("n").alias("words"), F.count("*").alias("rows"))
    parts = F.greatest(F.ceil(F.col("words") / SEGMENT_WORDS), F.ceil(F.col("rows") / SEGMENT_DOCS))
    # L words make at most sqrt(2 L) lengths, so the strata of several segments stay far below what can be broadcast; documents are then dealt once, by segment
    large = written(strata.withColumn("parts", parts).filter("parts > 1").select("m", "parts"))
    dealt = counted.withColumn("m", m).join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "m", "left").withColumn("block", F.pmod(F.xxhash64("_row"), F.coalesce("parts", F.lit(1))))
    made = dealt.select("m", "block", "_id", "_none", "terms", "tfs").groupBy("m", "block").applyInPandas(_segment, _SEGMENT)
    return Index(written(made), n_docs, n_terms)


def _items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id term q``: how often each item's text has each term."""
    counted = _counted(_rows(items, item_id, text))
    each = counted.select(F.when(~F.col("_none"), F.col("_id")).alias("item_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return each.groupBy("item_id", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("q"))


class _Batch:
    """The items of a batch as arrays: entries (item, term, weight) ordered by term and, for the bounds, by item."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, vocabulary: list[str]):
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        by_item = np.lexsort((term, item))
        self.by_item_term, self.by_item_weight = term[by_item], weight[by_item]
        self.n_items = int(item.max()) + 1
        self.starts = np.searchsorted(item[by_item], np.arange(self.n_items))
        self.number = {t: k for k, t in enumerate(vocabulary)}

    def hits(self, terms) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms of a segment stand in the vocabulary, and in the segment, of those in both."""
        number = self.number
        found = [(number[t], i) for i, t in enumerate(terms) if t in number]
        pair = np.array(found, np.int64).reshape(-1, 2)
        return pair[:, 0], pair[:, 1]

    def bounds(self, m: int, at: np.ndarray, top: np.ndarray) -> np.ndarray:
        """The most that any document of a segment can score for each item; ``top`` is the largest tf of the terms ``at``."""
        best = np.zeros(len(self.number), np.int64)
        best[at] = impact(top, m)
        return np.add.reduceat(self.by_item_weight * best[self.by_item_term], self.starts)


def _scores(batch: _Batch, seg, at: np.ndarray, where: np.ndarray, active: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of ``active`` items with the scores of all documents of a segment, one row an item."""
    first_run = np.concatenate([[0], np.cumsum(seg.runs)])
    first_doc = np.concatenate([[0], np.cumsum(seg.size)])
    gain = impact(np.asarray(seg.tf, np.int64), int(seg.m))
    docs = np.asarray(seg.docs, np.int64)
    for k in range(0, len(active), ITEM_BLOCK):
        some = active[k : k + ITEM_BLOCK]
        line = np.full(batch.n_items, -1)
        line[some] = np.arange(len(some))
        acc = np.zeros((len(some), int(seg.n_docs)), np.int64)
        for v, i in zip(at, where, strict=True):
            a, b = batch.first[v], batch.first[v + 1]
            rows = line[batch.item[a:b]]
            weight = batch.weight[a:b][rows >= 0]
            rows = rows[rows >= 0]
            if len(rows):
                for r in range(first_run[i], first_run[i + 1]):
                    acc[rows[:, None], docs[first_doc[r] : first_doc[r + 1]]] += (weight * gain[r])[:, None]
        yield some, acc


class _Best:
    """The k best documents of each item so far, and the score a further one must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.held, self.size = least.copy(), k, [], 0

    def add(self, some: np.ndarray, acc: np.ndarray, ids: np.ndarray) -> None:
        i, d = np.nonzero(acc >= np.maximum(self.least[some], 1)[:, None])
        known = d < len(ids)  # documents without id stand last
        self.held.append((some[i], acc[i, d], ~known, ids[np.where(known, d, 0)] if len(ids) else np.zeros(len(d), np.int64)))
        self.size += len(i)
        if self.size > 50_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, none, ids = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((ids, none, -score, item))
        item, score, none, ids = item[order], score[order], none[order], ids[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.k - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])
        keep = rank < self.k
        self.held = [(item[keep], score[keep], none[keep], ids[keep])]
        self.size = int(keep.sum())
        return self.held[0]

    def frame(self) -> pd.DataFrame:
        item, score, none, ids = self.cut()
        doc_id = pd.Series(ids, dtype="Int64").mask(none.astype(bool))
        return pd.DataFrame({"item": item.astype(np.int32), "score": score, "doc_id": doc_id})


def _bounded(segments: DataFrame, shared, k: int) -> DataFrame:
    """``item bound m block n_docs``: of every task and item the segments with the highest bounds that hold k documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch: _Batch = shared.value
        held = []
        for pdf in batches:
            for seg in pdf.itertuples(index=False):
                at, where = batch.hits(seg.terms)
                bound = batch.bounds(int(seg.m), at, np.asarray(seg.top, np.int64)[where])
                item = np.flatnonzero(bound > 0)
                held.append(pd.DataFrame({"item": item.astype(np.int32), "bound": bound[item], "m": seg.m, "block": seg.block, "n_docs": seg.n_docs}))
                if len(held) > 200:
                    held = [first_filling(pd.concat(held), k)]
        if held:
            yield first_filling(pd.concat(held), k)

    return segments.select("m", "block", "n_docs", "terms", "top").mapInPandas(slim(run), "item int, bound long, m long, block long, n_docs long")


def first_filling(bounds: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of each item the segments with the highest bounds that together hold k documents."""
    bounds = bounds.sort_values(["item", "bound", "m", "block"], ascending=[True, False, True, True])
    before = bounds.groupby("item")["n_docs"].cumsum() - bounds["n_docs"]
    return bounds[before < k]


def _visited(segments: DataFrame, shared, least: np.ndarray, k: int) -> DataFrame:
    """``item score doc_id``: the k best documents of each item in every task, of the segments whose bounds reach ``least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch: _Batch = shared.value
        best = _Best(least, k)
        for pdf in batches:
            visits = []
            for seg in pdf.itertuples(index=False):
                at, where = batch.hits(seg.terms)
                visits.append((batch.bounds(int(seg.m), at, np.asarray(seg.top, np.int64)[where]), seg, at, where))
            for bound, seg, at, where in sorted(visits, key=lambda v: -int(v[0].max())):
                active = np.flatnonzero(bound >= np.maximum(best.least, 1))
                for some, acc in _scores(batch, seg, at, where, active):
                    best.add(some, acc, np.asarray(seg.ids, np.int64))
                best.cut()
        yield best.frame()

    return segments.mapInPandas(slim(run), _BEST)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, *, item_id: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """``item_id rank doc_id score``: the k best documents of every item."""
    spark = items.sparkSession
    wanted = written(_items(items, item_id, text))
    n_batches = max(1, -(-wanted.count() // BATCH_TERMS))
    results = []
    for number in range(n_batches):
        some = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_batches)) == number)
        rows = some.withColumn("item_id", F.col("item_id").cast("string")).toPandas()  # about BATCH_TERMS rows
        if not len(rows):
            continue
        term, vocabulary = pd.factorize(rows["term"])
        item, names = pd.factorize(rows["item_id"], use_na_sentinel=False)
        df = _holding(index.segments, list(vocabulary))
        w = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * df + 1))).astype(np.int64)
        batch = _Batch(item.astype(np.int64), term, w[term] * rows["q"].to_numpy(np.int64), list(vocabulary))
        shared = spark.sparkContext.broadcast(batch)
        filled = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "block").rowsBetween(Window.unboundedPreceding, -1)
        bounds = _bounded(index.segments, shared, k).withColumn("before", F.coalesce(F.sum("n_docs").over(filled), F.lit(0)))
        chosen = bounds.filter(F.col("before") < k).select("m", "block").distinct()
        none = np.zeros(batch.n_items, np.int64)
        known = _ranked(_visited(index.segments.join(chosen, ["m", "block"], "left_semi"), shared, none, k), k).filter(F.col("rank") == k).toPandas()
        least = none.copy()
        least[known["item"].to_numpy(np.int64)] = known["score"].to_numpy(np.int64)
        named = spark.createDataFrame([(i, None if pd.isna(x) else int(x)) for i, x in enumerate(names)], "item int, item_id long")
        results.append(written(_ranked(_visited(index.segments, shared, least, k), k).join(named, "item").select("item_id", "rank", "doc_id", "score")))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def _holding(segments: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """In how many documents each term of a batch's vocabulary stands."""
    shared = segments.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        df = np.zeros(len(number), np.int64)
        for pdf in batches:
            for terms, held in zip(pdf["terms"], pdf["held"], strict=True):
                for t, h in zip(terms, held, strict=True):
                    if t in number:
                        df[number[t]] += h
        yield pd.DataFrame({"k": np.flatnonzero(df), "df": df[df > 0]})

    counts = segments.select("terms", "held").mapInPandas(slim(run), "k long, df long").groupBy("k").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[counts["k"].to_numpy(np.int64)] = counts["df"].to_numpy(np.int64)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS r FROM documents)),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS q FROM i GROUP BY ALL),
n AS (SELECT r, count(*) AS n FROM d GROUP BY r),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (r), s GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
