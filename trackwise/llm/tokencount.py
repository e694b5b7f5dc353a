"""Offset-mapped token counts: encode whole documents once, attribute tokens to sections.

Token boundaries are exact: byte lengths of ids are summed to byte spans and mapped to
character spans. The spans are interval-joined to the document's sections (sorted,
not overlapping) by bisection, both sides being in order. Allocation rule for
tokens at boundaries: a token that touches several sections goes to the one it shares
most characters with, the earlier on ties; a token that touches none (white space
between sections) goes to the section before it, or to the first section if none is
before. So every token is counted exactly once.

Defined results: null and empty texts have one empty section without tokens; a
document whose sections are given as an empty array or null has one section over the
whole text; rows that repeat an id are counted as rows of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.llm.text import light, slim


@lru_cache(maxsize=2)
def _encoder(name: str):
    """The encoder of a rank file, and the byte length of every id."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        sizes[i] = len(piece)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def char_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token; a token that starts inside a character starts at that character."""
    stop = np.cumsum(sizes[ids])
    start = stop - sizes[ids]
    if text.isascii():
        return start, stop
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return before[np.minimum(start + 1, len(lead))] - 1, before[stop]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the ``\\n``-split lines."""
    size = np.fromiter(map(len, text.split("\n")), np.int64)
    stop = np.cumsum(size + 1) - 1
    return stop - size, stop


def attribute(start: np.ndarray, stop: np.ndarray, sec_start: np.ndarray, sec_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token touches other than one section's characters."""
    first = np.searchsorted(sec_stop, start, "right")
    end = np.searchsorted(sec_start, stop, "left")
    own = np.minimum(first, len(sec_start) - 1)
    none = end <= first
    own[none] = np.maximum(end[none] - 1, 0)
    for i in np.flatnonzero(end - first > 1):
        s = np.arange(first[i], end[i])
        own[i] = s[np.argmax(np.minimum(sec_stop[s], stop[i]) - np.maximum(sec_start[s], start[i]))]
    inside = (start >= sec_start[own]) & (stop <= sec_stop[own])
    return own, ~inside


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sections: Column | None = None, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per document and section: ``doc_id section char_start char_end n_tokens n_boundary doc_tokens``.

    ``sections``: an array of structs ``start, stop`` in characters, sorted, not
    overlapping; if none is given, the lines of the text.
    """
    light(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sizes = _encoder(tokenizer)
        for pdf in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            ids, counts = [], []
            for d, t, own in zip(pdf["_id"].astype(object), pdf["_text"], pdf["_sections"], strict=True):
                t = t if isinstance(t, str) else ""
                toks = np.asarray(enc.encode_ordinary(t), np.int64)
                if sections is None:
                    a, b = line_sections(t)
                elif own is None or not len(own):
                    a, b = np.array([0]), np.array([len(t)])
                else:
                    a, b = np.array([x["start"] for x in own]), np.array([x["stop"] for x in own])
                n, edge = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                if len(toks):
                    sec, touches = attribute(*char_spans(t, toks, sizes), a, b)
                    n = np.bincount(sec, minlength=len(a))
                    edge = np.bincount(sec[touches], minlength=len(a))
                ids.append(None if pd.isna(d) else int(d))
                counts.append(len(a))
                for col, v in zip(out, (np.arange(len(a)), a, b, n, edge, np.full(len(a), len(toks))), strict=True):
                    col.append(v)
            if ids:
                cols = [np.concatenate(c) for c in out]
                frame = pd.DataFrame(dict(zip(("section", "char_start", "char_end", "n_tokens", "n_boundary", "doc_tokens"), cols, strict=True)))
                frame.insert(0, "doc_id", pd.array(ids, "Int64").repeat(counts))
                yield frame

    named = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), (F.lit(None).cast("string") if sections is None else sections).alias("_sections"))
    return named.mapInPandas(slim(run), "doc_id long, section long, char_start long, char_end long, n_tokens long, n_boundary long, doc_tokens long")
