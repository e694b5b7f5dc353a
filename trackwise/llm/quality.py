"""Quality rules with cross-document line frequency (DataFrame functions only).

Per document: word and symbol counts, repeated lines, repeated five-word windows.
Across documents: normalised lines are hashed, the distinct documents (ids) of each host
that hold a line are counted, lines above the limit are boilerplate, and a document
whose remaining words are too few is rejected as depleted.

Defined results: null text counts as empty (no words, ``base_failed`` is true); a
null host is a host of its own; rows that repeat an id and a text share one verdict;
rows without id are documents by their text; with ``near_once`` documents that share most
of their lines are one document to the line counts, so that a page that is merely copied,
or nearly, is left to deduplication; columns other than the named ones are kept
out of the result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.llm.text import SPACE_CLASS, WORD_CLASS, let, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1

        def twin(_: Column, i: Column) -> Column:
            own = pairs[i]["h"]
            before = F.when(i > 0, pairs[i - 1]["h"] == own).otherwise(False)
            return before | F.when(i < last, pairs[i + 1]["h"] == own).otherwise(False)

        starts = F.array_sort(F.transform(F.filter(pairs, twin), lambda x: x["i"]))
        total = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                (p + WINDOW).alias("end"),
                (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"),
            ),
        )
        return total["n"]

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(pairs, covered)


def _window_hashes(hashes: Column) -> Column:
    last = F.size(hashes) - WINDOW
    one = lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def document_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add ``n_words word_chars n_symbols n_dup_lines n_repeat_words`` to every row; no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    dup_lines = let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    hashes = F.transform(words(t), lambda w: F.xxhash64(w))
    repeats = let(
        hashes,
        lambda h: F.struct(
            F.size(h).cast("long").alias("n"),
            let(
                _window_hashes(h),
                lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _repeated_words(w)).otherwise(F.lit(0)),
            ).cast("long").alias("r"),
        ),
    )
    out = docs.select(
        "*",
        F.char_length(F.regexp_replace(t, SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        repeats.alias("_repeats"),
    )
    return out.select(
        *[c for c in out.columns if c != "_repeats"],
        F.col("_repeats.n").alias("n_words"),
        F.col("_repeats.r").alias("n_repeat_words"),
    )


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE_CLASS + "+", " "))


def _lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: ``_host _id _text_hash _norm _at _line _n``; ``_norm`` is the hash of all normalised lines."""
    each = F.transform(
        F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: x.rlike(WORD_CLASS)),
        lambda x, i: let(
            _normal(x),
            lambda y: F.struct(i.alias("at"), F.xxhash64(y).alias("line"), (F.char_length(y) - F.char_length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("n")),
        ),
    )
    of_text = docs.select("_host", "_id", "_text_hash", each.alias("all")).select("_host", "_id", "_text_hash", "all", F.xxhash64(F.col("all.line")).alias("_norm"))
    return of_text.select("_host", "_id", "_text_hash", "_norm", F.explode("all").alias("x")).select(
        "_host", "_id", "_text_hash", "_norm", F.col("x.at").alias("_at"), F.col("x.line").alias("_line"), F.col("x.n").alias("_n")
    )


def _signed(lines: DataFrame, limit: int, salts: int) -> DataFrame:
    """The lines again with ``_text_hash`` for counting: near copies share it at each line.

    A text is known by its normalised lines. Where lines that more than ``limit`` of these
    texts hold make up most of a text's words, the text counts at a line as the least
    hash among its other such lines: texts that share most of their lines have few
    different least hashes (about log N of N near copies), whichever lines were changed.
    """
    # one row per normalised text, host and place of a line
    each = lines.groupBy("_host", "_norm", "_at").agg(F.first("_line").alias("_line"), F.first("_n").alias("_n"))
    hot = boilerplate_lines(each.withColumnRenamed("_norm", "_text_hash"), limit).select(
        F.col("_host").alias("_kh"), F.col("_line").alias("_kl"), F.lit(True).alias("_hot"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_ks"),
    )
    salted = each.withColumn("_salt", F.pmod(F.xxhash64("_norm", "_at"), F.lit(salts)).cast("int"))
    own_line = F.col("_host").eqNullSafe(F.col("_kh")) & (F.col("_line") == F.col("_kl")) & (F.col("_salt") == F.col("_ks"))
    marked = salted.join(hot, own_line, "left").select("_host", "_norm", "_line", "_n", F.coalesce("_hot", F.lit(False)).alias("_hot"))
    texts = marked.groupBy("_host", "_norm").agg(
        (2 * F.sum(F.when(F.col("_hot"), F.col("_n")).otherwise(0)) > F.sum("_n")).alias("_most"),
        F.array_sort(F.collect_set(F.when(F.col("_hot"), F.struct(F.xxhash64("_line").alias("h"), F.col("_line").alias("line"))))).alias("_shared"),
        F.collect_set(F.when(F.col("_hot"), F.col("_line"))).alias("_lines"),
    )
    opened = texts.withColumn("_shared", F.slice("_shared", 1, 2)).select("_host", "_norm", "_most", "_shared", F.explode("_lines").alias("_line"))
    others = F.filter("_shared", lambda x: x["line"] != F.col("_line"))
    sign = F.when(F.col("_most"), F.coalesce(F.try_element_at(others, F.lit(1))["h"], F.lit(0))).otherwise(F.col("_norm"))
    return opened.select("_host", "_line", sign.alias("_text_hash"))


def boilerplate_lines(lines: DataFrame, limit: int) -> DataFrame:
    """Lines that more than ``limit`` distinct documents (by ``_text_hash``) of one host hold."""
    once = lines.groupBy("_host", "_line", "_text_hash").agg(F.lit(1).alias("one"))
    return once.groupBy("_host", "_line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > limit)


def removed_words(docs: DataFrame, *, limit: int, salts: int, near_once: bool = True) -> DataFrame:
    """Per document (id and text) the words that stand in boilerplate lines, and the hashes of these ``lines``; only documents that have some.

    ``near_once``: documents that share most of their lines are one document to the counts; otherwise each id is one.

    A very common line is held by a large share of the rows, so the join key is
    salted: the boilerplate side is repeated ``salts`` times.
    """
    lines = _lines(docs)
    hot = boilerplate_lines(_signed(lines, limit, salts) if near_once else lines.withColumn("_text_hash", F.when(F.col("_id").isNotNull(), F.xxhash64("_id")).otherwise(F.col("_text_hash"))), limit).select(
        F.coalesce("_host", F.lit("")).alias("_h"), F.col("_host").isNull().alias("_hn"), "_line",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    keyed = lines.select(
        "_id", "_text_hash", "_at", "_n", "_line",
        F.coalesce("_host", F.lit("")).alias("_h"), F.col("_host").isNull().alias("_hn"),
        F.pmod(F.xxhash64("_id", "_text_hash", "_at"), F.lit(salts)).cast("int").alias("_salt"),
    )
    met = keyed.join(hot, ["_h", "_hn", "_line", "_salt"], "left_semi")
    return met.groupBy("_id", "_text_hash", "_at").agg(F.max("_n").alias("_n"), F.first("_line").alias("_line")).groupBy("_id", "_text_hash").agg(F.sum("_n").alias("removed_words"), F.collect_set("_line").alias("lines"))


def _named(docs: DataFrame, doc_id: str, text: str, host: str, *more: Column) -> DataFrame:
    return docs.select(
        *more,
        F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(host).cast("string").alias("_host"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_hash"),
    )


def quality_rules(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    limit: int = 20, min_left: int = 10, salts: int = 32, near_once: bool = False,
) -> DataFrame:
    """Counts and verdict per row of ``docs``.

    ``limit``: a line is boilerplate when more distinct documents of its host hold it.
    ``min_left``: a document is depleted when fewer words than this are left.
    ``near_once``: see ``removed_words``.
    """
    own = _named(docs, doc_id, text, host)
    counted = document_counts(own, text="_text").drop("_text", "_host")
    removed = removed_words(own, limit=limit, salts=salts, near_once=near_once).withColumnsRenamed({"_id": "_rid", "_text_hash": "_rhash"})
    met = counted.join(removed, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_text_hash") == F.col("_rhash")), "left")
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (gone > 0) & (F.col("n_words") - gone < min_left)
    return met.select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("removed_words"),
    )


def without_lines(text: Column, lines: Column) -> Column:
    """A text's lines in their order without those whose normalised hash is in ``lines``; blank lines stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(WORD_CLASS) & F.array_contains(lines, F.xxhash64(_normal(x))))), "\n")


def keep_good(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars",
    limit: int = 20, min_left: int = 10, salts: int = 32,
) -> DataFrame:
    """The rows of ``docs`` that pass, their texts without boilerplate lines and ``n_chars``, if there is one, by the text left; other columns unchanged, whatever their names.

    Near copies count once here (see ``removed_words``). Null and empty texts go, rows that
    repeat an id and text stay or go together, an empty table stays empty.
    """
    own = _named(docs, doc_id, text, host, F.struct("*").alias("__row"))
    counted = document_counts(own, text="_text")
    good = counted.filter((F.col("n_words") >= 10) & (100 * F.col("n_repeat_words") <= 20 * F.col("n_words")))
    few = removed_words(_named(docs, doc_id, text, host), limit=limit, salts=salts).withColumnsRenamed({"_id": "_rid", "_text_hash": "_rhash", "removed_words": "_gone", "lines": "_hot_lines"})
    met = good.join(few, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_text_hash") == F.col("_rhash")), "left")
    passed = met.filter(F.col("_gone").isNull() | (F.col("n_words") - F.col("_gone") >= min_left))
    field = lambda c: F.col("__row").getField(c)
    left = F.when(F.col("_gone").isNull(), field(text)).otherwise(without_lines(field(text), F.col("_hot_lines")))
    new = {text: left, n_chars: F.when(F.col("_gone").isNull(), field(n_chars)).otherwise(F.char_length(left).cast(docs.schema[n_chars].dataType))} if n_chars in docs.columns else {text: left}
    return passed.select(*[new.get(c, field(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source, md5(coalesce(text, '')) AS th FROM documents),
w AS (SELECT doc_id, th, t, source, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 3, 1))) AS i, ws FROM w WHERE len(ws) >= 5),
win2 AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM win),
rep AS (SELECT doc_id, g FROM win2 GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT DISTINCT win2.doc_id, i + k AS p FROM win2 JOIN rep ON rep.doc_id = win2.doc_id AND rep.g = win2.g, range(0, 5) r(k)),
nrep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
ln AS (SELECT doc_id, source, th, trim(regexp_replace(lower(unnest(ls)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l FROM w),
hot AS (SELECT source, l FROM (SELECT source, l, count(DISTINCT doc_id) AS n FROM ln GROUP BY source, l) WHERE n > 20),
gone AS (SELECT ln.doc_id, sum(len(ln.l) - len(replace(ln.l, ' ', '')) + 1) AS n FROM ln JOIN hot ON hot.source IS NOT DISTINCT FROM ln.source AND hot.l = ln.l GROUP BY ln.doc_id),
x AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(nrep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN nrep ON nrep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0 AND n_words - removed_words < 10) AS kept
FROM x
"""
