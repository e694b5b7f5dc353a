"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: code points of the lower-cased text, white space and digits each folded to
one sign; all runs of one to ``MAX_N`` code points are hashed to ``2**BITS`` buckets.
Document frequencies are counted over all training documents. The weights are fitted
by follow-the-regularised-leader with elastic-net penalties (L1 makes them sparse) on
a bounded sample: about ``rows_per_lang`` training documents of each language, chosen
by a hash of the id. A fifth of the sample is kept back to calibrate a temperature.

Defined results: a text that is null or has no letter is ``und`` with score 0.0; so is
every text if there is nothing to learn from. Rows without id are never learned from
and never held out. Scores are the calibrated probability of the predicted language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.llm.text import light, slim

BITS, MAX_N = 15, 3
DIM = 1 << BITS
_LETTER = re.compile(r"[^\W\d_]")
_MULT = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (ascending) and counts of a text's n-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 33, np.uint32(32), np.where((c > 47) & (c < 58), np.uint32(48), c))
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    total = np.zeros(DIM, np.int64)
    h = c * _MULT[0]
    for n in range(1, MAX_N + 1):
        mixed = (h ^ (h >> np.uint32(15))) * _MULT[2]
        total += np.bincount(mixed >> np.uint32(32 - BITS), minlength=DIM)
        if n < MAX_N:
            h = (h[:-1] + np.uint32(n)) * _MULT[1] + c[n:] * _MULT[0]
    at = np.flatnonzero(total)
    return at, total[at]


def weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length."""
    v = (1 + np.log(count)) * idf[at]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (languages, DIM)
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ v + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not isinstance(text, str) or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        at, count = ngrams(text)
        z = self.logits(at, weigh(at, count, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_langs: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal updates, one document at a time; the last column is the bias."""
    z, n = np.zeros((n_langs, DIM + 1)), np.zeros((n_langs, DIM + 1))

    def solved(at: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[:, at], n[:, at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for _ in range(epochs):
        for (at, v), y in zip(rows, labels, strict=True):
            at, v = np.append(at, DIM), np.append(v, 1.0)
            w = solved(at)
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * v
            n_old = n[:, at]
            n_new = n_old + g * g
            z[:, at] += g - (np.sqrt(n_new) - np.sqrt(n_old)) / alpha * w
            n[:, at] = n_new
    w = solved(slice(None))
    return w[:, :DIM], w[:, DIM]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, of a fixed ladder, with the least log loss; 1.0 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    return float(min(np.geomspace(0.05, 20, 81), key=loss))


def _remainder(doc_id: str, mod: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out_mod: int = 5, rows_per_lang: int = 800, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> Model:
    """Fit a model on the documents of non-null language whose crc32 of the id is not divisible by ``held_out_mod``."""
    light(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (_remainder("_id", held_out_mod) != 0))
    n_of = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n_of)
    if not langs:
        return Model([], np.zeros((0, DIM)), np.zeros(0), np.ones(DIM), 1.0)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows_per_lang / n_of[k]))])[F.col("_lang")]
    drawn = (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)) < share

    def one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM, np.int64), 0
        for pdf in batches:
            kept = []
            for d, t, k, use in zip(pdf["_id"], pdf["_text"], pdf["_lang"], pdf["_drawn"], strict=True):
                at, count = ngrams(t)
                df[at] += 1
                n += 1
                if use:
                    kept.append((-1, 0, str(d), k, at.astype("<u2").tobytes(), np.minimum(count, 2**31 - 1).astype("<u4").tobytes()))
            if kept:
                yield pd.DataFrame(kept, columns=cols)
        at = np.flatnonzero(df)
        yield pd.DataFrame([(DIM, n, None, None, None, None)], columns=cols)
        yield pd.DataFrame({"bucket": at, "n": df[at], "id": None, "lang": None, "at": None, "count": None})

    cols = ["bucket", "n", "id", "lang", "at", "count"]
    seen = rows.select("_id", "_text", "_lang", drawn.alias("_drawn")).mapInPandas(slim(one_pass), "bucket long, n long, id string, lang string, at binary, count binary")
    # one row per bucket and one per drawn document: both bounded by the parameters
    summed = seen.groupBy("bucket", "id", "lang", "at", "count").agg(F.sum("n").alias("n")).toPandas()
    freq = summed[summed["bucket"] >= 0]
    n_docs = int(freq.loc[freq["bucket"] == DIM, "n"].sum())
    df = np.zeros(DIM + 1)
    df[freq["bucket"].to_numpy()] = freq["n"]
    idf = np.log((1 + n_docs) / (1 + df[:DIM])) + 1
    sample = summed[summed["bucket"] < 0].copy()
    sample["o"] = pd.util.hash_array(sample["id"].to_numpy(dtype=object))
    sample = sample.sort_values(["o", "id", "lang"])
    number = {k: i for i, k in enumerate(langs)}
    feats = [(a := np.frombuffer(x, "<u2").astype(np.int64), weigh(a, np.frombuffer(c, "<u4").astype(np.int64), idf)) for x, c in zip(sample["at"], sample["count"], strict=True)]
    labels = sample["lang"].map(number).to_numpy()
    back = (np.arange(len(feats)) % 5 == 4) if len(feats) >= 50 else np.zeros(len(feats), bool)
    w, b = fit_ftrl([f for f, x in zip(feats, back, strict=True) if not x], labels[~back], len(langs), alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    logits = np.array([w[:, at] @ v + b for (at, v), x in zip(feats, back, strict=True) if x]).reshape(-1, len(langs))
    return Model(langs, w.astype(np.float32), b, idf, calibrate(logits, labels[back]))


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with columns ``lang_pred`` and ``score``, in the place of any that have these names; only the text is read for the prediction. Of equal probabilities the first language by name wins."""
    light(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(F.struct(*rest).alias("_row"), guess(F.col(text)).alias("_guess"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in rest], F.col("_guess.lang_pred").alias("lang_pred"), F.col("_guess.score").alias("score"))


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held_out_mod: int = 5, **fit) -> DataFrame:
    """Per row of ``docs``: ``doc_id held_out lang_pred score``."""
    model = train(docs, doc_id=doc_id, text=text, lang=lang, held_out_mod=held_out_mod, **fit)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    held = F.coalesce(_remainder("doc_id", held_out_mod) == 0, F.lit(False))
    return predict(rows, model, text="_text").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, *, min_score: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **fit) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``min_score``, columns unchanged, whatever their names; texts that are null, empty or without letters go, rows that repeat an id are judged by their own texts, an empty table stays empty."""
    model = train(docs, doc_id=doc_id, text=text, lang=lang, **fit)
    tagged = predict(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), model, text="_text")
    return tagged.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("_row.*")
