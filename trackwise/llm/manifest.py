"""A Merkle manifest of a dataset, with a proof for every row, by an exchange of subtrees.

The leaves of a group (a source), in order of their ids, form a tree of ``FANOUT``
children a node; the roots of the groups, in order of the groups, form a tree above
them. A run of ``SUPER`` consecutive nodes of a tree is a superblock: one task reduces
it to one node of the level above, whatever the size of its group, so that a group of
a third of all rows is dealt to as many tasks as it has superblocks.

1. Up: every superblock is reduced to its top node; the top nodes of a group are
   numbered by their superblocks and reduced in turn, until each group has one node;
   then the groups' roots likewise, until one root is left.
2. Down: the nodes of a superblock and the outer nodes its proofs need (the siblings
   of its top node, level by level up to the root) are cogrouped. That one task reduces
   the superblock again, joins the inner siblings to the outer ones and passes on the
   siblings of each of its nodes. In the last exchange, over the leaves, it also folds
   each leaf, or its tampered form, with them.

Only hashes travel: a row's text is read once. An outer row holds at most ``FANOUT - 1``
hashes a level and goes to one superblock.

Defined results: a null in any column is ``-`` in its leaf; null sources come first, rows
without id before the others of their source; rows that repeat an id are leaves of their
own, ordered by their leaf; equal rows have the same subroot and root but each its own
place and proof. An empty table gives no rows. Columns other than the named ones are
neither hashed nor returned.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.llm.text import LOWER, UPPER, light, written

FANOUT = 16
LEVELS = 3
SUPER = FANOUT**LEVELS
_STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row's values, in lowercase hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def lifted(nodes: list[str], total: int) -> list[list[str]]:
    """The levels of a superblock from its nodes to its top node; ``total`` nodes stand on the lowest level of the whole tree."""
    levels = [nodes]
    while total > 1 and len(levels) <= LEVELS:
        low = levels[-1]
        levels.append([digest("".join(low[k : k + FANOUT])) for k in range(0, len(low), FANOUT)])
        total = -(-total // FANOUT)
    return levels


def inner_steps(levels: list[list[str]]) -> list[list[dict]]:
    """For every node of the lowest level its siblings on the left and on the right, level by level inside the superblock."""
    runs = [[low[k : k + FANOUT] for k in range(0, len(low), FANOUT)] for low in levels[:-1]]
    made = [[[{"left": "".join(run[:i]), "right": "".join(run[i + 1 :])} for i in range(len(run))] for run in level] for level in runs]
    return [[level[at // FANOUT ** (k + 1)][at // FANOUT**k % FANOUT] for k, level in enumerate(made)] for at in range(len(levels[0]))]


def fold(node: str, steps: list[dict]) -> str:
    """The root that a leaf gives with the siblings of its path."""
    for s in steps:
        node = digest(s["left"] + node + s["right"])
    return node


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place of each in its group by ``order`` (from 0), and ``total``, the size of its group.

    Rows are dealt by ranges, so that a large group is spread; the counts of the parts of
    a group before a range give its first place. Equal rows are dealt by where they were read.
    """
    dealt = rows.withColumn("_read", F.monotonically_increasing_id())
    keys = [*group, *order, "_read"]
    sorted_rows = written(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read").withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", 33)
    pieces = sorted_rows.groupBy(*group, part.alias("_part")).agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*[F.col(g).alias(f"_{g}") for g in group], "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("total"))
    same = part == F.col("_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    found = sorted_rows.join(pieces, same)
    return found.withColumn("at", F.col("_n") + F.col("_shift")).drop("_n", "_shift", "_part", *[f"_{g}" for g in group])


def _block() -> Column:
    return F.floor(F.col("at") / SUPER).cast("long")


def reduced(nodes: DataFrame) -> DataFrame:
    """``grp at total node``: the top nodes of all superblocks of ``nodes`` (the same columns), numbered in their group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        total = int(pdf["total"].iloc[0])
        top = lifted(list(pdf["node"]), total)[-1][0]
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "at": [key[1]], "total": [-(-total // SUPER)], "node": [top]})

    made = nodes.select("grp", "at", "total", "node", _block().alias("block")).groupBy("grp", "block").applyInPandas(run, "grp string, at long, total long, node string")
    return written(made)


def _towers(base: DataFrame) -> list[DataFrame]:
    """``base`` and what it is reduced to, until every group has one node."""
    levels = [base]
    while levels[-1].filter("total > 1").limit(1).count():
        levels.append(reduced(levels[-1]))
    return levels


def exchanged(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """``grp at node steps subroot root``: every node with all its siblings up to the root, from the ``steps`` of its superblock's top node (row ``grp at``)."""

    def run(key: tuple, low: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        low = low.sort_values("at")
        above = list(out["steps"].iloc[0])
        inner = inner_steps(lifted(list(low["node"]), int(low["total"].iloc[0])))
        return pd.DataFrame({
            "grp": low["grp"], "at": low["at"], "node": low["node"], "steps": [[*own, *above] for own in inner],
            "subroot": out["subroot"].iloc[0], "root": out["root"].iloc[0],
        })

    low = nodes.select("grp", "at", "total", "node", _block().alias("block")).groupBy("grp", "block")
    high = outer.select("grp", F.col("at").alias("block"), "steps", "subroot", "root").groupBy("grp", "block")
    return low.cogroup(high).applyInPandas(run, f"grp string, at long, node string, steps array<{_STEP}>, subroot string, root string")


def folded(leaves: DataFrame, outer: DataFrame) -> DataFrame:
    """The last exchange: local reduction, proofs and folds of the leaves of each superblock."""

    def run(key: tuple, low: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        low = low.sort_values("at")
        above = list(out["steps"].iloc[0])
        outside = "".join(s["left"] + s["right"] for s in above)
        nodes = list(low["node"])
        inner = inner_steps(lifted(nodes, int(low["total"].iloc[0])))
        root = out["root"].iloc[0]
        back = [fold(changed or own, [*steps, *above]) for own, changed, steps in zip(nodes, low["changed"], inner, strict=True)]
        return pd.DataFrame({
            "doc_id": low["id"], "leaf": nodes, "subroot": out["subroot"].iloc[0], "root": root,
            "proof_sha256": [digest("".join(s["left"] + s["right"] for s in steps) + outside) for steps in inner],
            "folded_root": back, "verified": [b == root for b in back],
        })

    low = leaves.select("grp", "at", "total", "node", "changed", F.col("id").cast("string").alias("id"), _block().alias("block")).groupBy("grp", "block")
    high = outer.select("grp", F.col("at").alias("block"), "steps", "subroot", "root").groupBy("grp", "block")
    # ids travel as text, as pandas would turn a column with nulls into floats
    return low.cogroup(high).applyInPandas(run, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest(rows: DataFrame) -> DataFrame:
    """One row per leaf of ``rows`` (``id grp node changed``; ``changed`` is the leaf of a tampered row or null): its proof and what it folds to."""
    light(rows.sparkSession)
    leaves = written(ranked(written(rows.select("id", "grp", "node", "changed")), ["grp"], ["id", "node"]))
    groups = _towers(leaves)
    # the place of a group's root among all is kept beside its name: the upper tree is one group of its own
    roots = ranked(groups[-1].select(F.lit(None).cast("string").alias("top"), F.col("grp").alias("name"), "node"), ["top"], ["name"])
    roots = written(roots.select(F.lit("").alias("grp"), "at", "total", "node", "name"))
    upper = _towers(roots.drop("name"))
    none = F.array().cast(f"array<{_STEP}>")
    outer = upper[-1].select("grp", "at", none.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(upper[:-1]):
        outer = written(exchanged(nodes, outer)).select("grp", "at", "steps", "subroot", "root")
    named = roots.select("at", F.col("name").alias("grp"), F.col("node").alias("subroot"))
    outer = named.join(outer.select("at", "steps", "root"), "at").select("grp", F.lit(0).cast("long").alias("at"), "steps", "subroot", "root")
    for nodes in reversed(groups[1:-1]):
        outer = written(exchanged(nodes, outer)).select("grp", "at", "steps", "subroot", "root")
    return folded(leaves, outer)


def document_leaves(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """``id grp node changed`` of documents; where ``tampered`` holds, ``changed`` is the leaf of the document with A-Z of its text in lower case."""
    i, s, la, n, t = (F.col(c) for c in (doc_id, source, lang, n_chars, text))
    changed = F.when(tampered, leaf(i, s, la, n, F.translate(t, UPPER, LOWER))) if tampered is not None else F.lit(None).cast("string")
    return docs.select(i.cast("long").alias("id"), s.cast("string").alias("grp"), leaf(i, s, la, n, t).alias("node"), changed.alias("changed"))


def fifth(doc_id: str = "doc_id") -> Column:
    """Whether 5 divides the crc32 of the decimal id; rows without id are not tampered with."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: DuckDB has no crc32: its table of 256 remainders is built by its rule, 8 divisions by the polynomial 0xEDB88320.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS c FROM range(256) r(i))),
d AS (
  SELECT doc_id, source, lang, n_chars, text,
    coalesce(xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT)),
      lambda a, b: xor(a // 256, tab[CAST(xor(a % 256, b) AS INT) + 1]), 4294967295), 4294967295) % 5 = 0, false) AS bad FROM documents, t),
h AS (
  SELECT doc_id, source, bad,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text FROM d),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN bad THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
up(source, lvl, pos, n, node) AS (
  SELECT source, 0, pos, n, leaf FROM r
  UNION ALL
  SELECT source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, lvl, pos // 16, (n + 15) // 16),
tops AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, lvl AS depth FROM up WHERE n = 1),
over(lvl, pos, n, node) AS (
  SELECT 0, pos, n, node FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY lvl, pos // 16, (n + 15) // 16),
every AS (
  SELECT r.doc_id, r.source, r.pos AS leaf_pos, u.lvl, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < u.pos), '') AS l, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > u.pos), '') AS rt
  FROM r JOIN up u ON u.source IS NOT DISTINCT FROM r.source AND u.n > 1 AND u.pos = r.pos // CAST(pow(16, u.lvl) AS BIGINT)
  JOIN up s ON s.source IS NOT DISTINCT FROM u.source AND s.lvl = u.lvl AND s.pos // 16 = u.pos // 16
  GROUP BY ALL
  UNION ALL
  SELECT r.doc_id, r.source, r.pos, t.depth + o.lvl, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < o.pos), ''), coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > o.pos), '')
  FROM r JOIN tops t ON t.source IS NOT DISTINCT FROM r.source JOIN over o ON o.n > 1 AND o.pos = t.pos // CAST(pow(16, o.lvl) AS BIGINT)
  JOIN over s ON s.lvl = o.lvl AND s.pos // 16 = o.pos // 16
  GROUP BY r.doc_id, r.source, r.pos, t.depth, o.lvl, o.pos),
steps AS (SELECT source, leaf_pos, list({'l': l, 'r': rt} ORDER BY lvl) AS s, string_agg(l || rt, '' ORDER BY lvl) AS proof FROM every GROUP BY source, leaf_pos),
f(source, pos, k, node, s) AS (
  SELECT r.source, r.pos, 1, coalesce(r.changed, r.leaf), coalesce(steps.s, []) FROM r LEFT JOIN steps ON steps.source IS NOT DISTINCT FROM r.source AND steps.leaf_pos = r.pos
  UNION ALL
  SELECT source, pos, k + 1, sha256(s[k].l || node || s[k].r), s FROM f WHERE k <= len(s))
SELECT r.doc_id, r.leaf, tops.node AS subroot, (SELECT node FROM over WHERE n = 1) AS root, sha256(coalesce(steps.proof, '')) AS proof_sha256,
  f.node AS folded_root, f.node = (SELECT node FROM over WHERE n = 1) AS verified
FROM r JOIN tops ON tops.source IS NOT DISTINCT FROM r.source JOIN f ON f.source IS NOT DISTINCT FROM r.source AND f.pos = r.pos AND f.k = len(f.s) + 1
LEFT JOIN steps ON steps.source IS NOT DISTINCT FROM r.source AND steps.leaf_pos = r.pos
"""
