"""Decision trees as node tables: fitting by level-wise aggregation, pruning, scoring expressions.

A node table has ``tree_key path level feature op threshold value n_goal n_other``; the
root's path is R, a child's its parent's with T or F. Fitting reads the samples once a
level for all trees, nodes and features together; the driver holds nodes only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackwise.shared import kept

NODE_SCHEMA = "tree_key string, path string, level int, feature string, op string, threshold double, value double, n_goal double, n_other double, gain double"


def normalisers(n: float, n_goal: float, alpha: float) -> tuple[float, float]:
    """Weights that balance goal and other samples of a tree."""
    return (n + 2 * alpha) / 2 / (n_goal + alpha), (n + 2 * alpha) / 2 / (n - n_goal + alpha)


def node_value(ng: float, n: float, g: float, h: float, alpha: float) -> float:
    up = (ng + alpha) * g
    return up / (up + (n - ng + alpha) * h)


def impurity(ng: float, n: float, g: float, h: float, alpha: float) -> float:
    """Balanced cross-entropy of a node."""
    p = (ng + alpha) / (n + 2 * alpha)
    term = lambda w, q: 0.0 if q <= 0 else w * q * math.log(q)
    return -term(g, p) - term(h, 1 - p)


def impurity_expr(ng: Column, n: Column, g: Column, h: Column, alpha: Column) -> Column:
    p = (ng + alpha) / (n + 2 * alpha)
    term = lambda w, q: F.when(q <= 0, F.lit(0.0)).otherwise(w * q * F.ln(q))
    return -term(g, p) - term(h, 1 - p)


def gini_expr(ng: Column, n: Column, g: Column, h: Column, alpha: Column) -> Column:
    a, b = ng * g, (n - ng) * h
    p = a / (a + b)
    return F.when(a + b > 0, 2 * p * (1 - p)).otherwise(F.lit(0.0))


def totals(samples: DataFrame, by: list[str], weight: str = "weight", goal: str = "has_goal", times: str | None = None) -> DataFrame:
    """Weight, goal weight and samples per group; ``times``: the column that says for how many samples a row stands."""
    w = F.col(weight)
    return samples.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(F.when(F.col(goal), w).otherwise(F.lit(0.0))).alias("ng"), (F.sum(times) if times else F.count("*")).alias("rows"))


def alike(samples: DataFrame, by: list[str], weight: str = "weight", times: str = "times") -> DataFrame:
    """Samples that agree in ``by`` as one row with their ``weight`` and their number ``times``; a fit over these rows is that over the samples."""
    return samples.groupBy(*by).agg(F.sum(weight).alias(weight), F.count("*").alias(times))


SEGMENT = ["tree_key", "path", "feature"]


def prefix_sums(distinct: DataFrame) -> DataFrame:
    """``SEGMENT v lw lg lk next sw sg sk``: for each distinct value the sums up to it, the next value and the sums of its whole segment, from ``SEGMENT v w wg k``.

    Values are dealt by ranges of (segment, value), so a feature with many values is spread
    over as many tasks as its values fill; sums inside a range are then shifted by those of the
    segment's ranges before it, of which there are as many as ranges, not as values.
    """
    ranges = kept(kept(distinct).repartitionByRange(*SEGMENT, "v").withColumn("part", F.spark_partition_id()))
    pieces = ranges.groupBy(*SEGMENT, "part").agg(F.sum("w").alias("pw"), F.sum("wg").alias("pg"), F.sum("k").alias("pk"), F.min("v").alias("first"))
    along = Window.partitionBy(*SEGMENT).orderBy("part")
    before, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*SEGMENT)
    shifts = pieces.select(
        *SEGMENT, "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in ("pw", "pg", "pk")],
        F.lead("first").over(along).alias("after"), *[F.sum(c).over(whole).alias(n) for c, n in (("pw", "sw"), ("pg", "sg"), ("pk", "sk"))],
    )
    inside = Window.partitionBy("part", *SEGMENT).orderBy("v")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = ranges.select(*SEGMENT, "part", "v", *[F.sum(c).over(run).alias(n) for c, n in (("w", "lw"), ("wg", "lg"), ("k", "lk"))], F.lead("v").over(inside).alias("next"))
    met = own.join(shifts, [*SEGMENT, "part"])
    return met.select(*SEGMENT, "v", (F.col("lw") + F.col("bpw")).alias("lw"), (F.col("lg") + F.col("bpg")).alias("lg"), (F.col("lk") + F.col("bpk")).alias("lk"), F.coalesce("next", "after").alias("next"), "sw", "sg", "sk")


AHEAD = "ahead/"


def split_gains(
    samples: DataFrame, nodes: DataFrame, features: list[str], criterion: str = "entropy", weight: str = "weight", goal: str = "has_goal", min_child: int = 0,
    ahead: dict[str, str] | None = None, lookahead_totals: str = "child", times: str | None = None,
) -> DataFrame:
    """Best threshold and gain of every (tree, node, feature), in one pass over the samples.

    ``samples`` carries ``tree_key path``; ``nodes`` has ``tree_key path n ng rows tree_n g h alpha``
    and is as small as the trees. Features are stacked and summed to distinct values
    before anything is ordered. ``ahead`` maps features to indicators: each such feature is
    also scored among the rows whose indicator is false, under the name ``ahead/feature``, either
    by the totals of those rows or (``parent``) by those of the node.
    """
    one = lambda name, v: F.struct(F.lit(name).alias("feature"), v.cast("double").alias("v"))
    values = [one(f, F.col(f)) for f in features] + [one(AHEAD + f, F.when(~F.col(i), F.col(f))) for f, i in (ahead or {}).items()]
    w = F.col(weight)
    stacked = samples.select("tree_key", "path", w.alias("w"), (F.col(times) if times else F.lit(1).cast("long")).alias("k"), F.when(F.col(goal), w).otherwise(F.lit(0.0)).alias("wg"), F.explode(F.array(*values)).alias("x")).filter(F.col("x.v").isNotNull())
    distinct = stacked.groupBy("tree_key", "path", F.col("x.feature").alias("feature"), F.col("x.v").alias("v")).agg(F.sum("w").alias("w"), F.sum("wg").alias("wg"), F.sum("k").alias("k"))
    met = prefix_sums(distinct).filter(F.col("next").isNotNull()).join(F.broadcast(nodes), ["tree_key", "path"])  # as small as the trees
    imp = impurity_expr if criterion == "entropy" else gini_expr
    g, h, a = F.col("g"), F.col("h"), F.col("alpha")
    looks = F.col("feature").startswith(AHEAD)
    own = looks & F.lit(lookahead_totals == "child")
    n, ng = F.when(own, F.col("sw")).otherwise(F.col("n")), F.when(own, F.col("sg")).otherwise(F.col("ng"))
    whole = imp(F.when(looks, F.col("sg")).otherwise(ng), F.when(looks, F.col("sw")).otherwise(n), g, h, a)
    rw, rg = n - F.col("lw"), ng - F.col("lg")
    gain = n / F.col("tree_n") * (whole - (F.col("lw") / n) * imp(F.col("lg"), F.col("lw"), g, h, a) - (rw / n) * imp(rg, rw, g, h, a))
    scored = met.withColumn("gain", F.round(gain, 12)).withColumn("threshold", (F.col("v") + F.col("next")) / 2)
    if min_child:
        scored = scored.filter((F.col("lk") >= min_child) & (F.when(looks, F.col("sk")).otherwise(F.col("rows")) - F.col("lk") >= min_child))
    best = F.max_by(F.struct("gain", "threshold"), F.struct(F.col("gain"), -F.col("threshold")))
    return scored.groupBy(*SEGMENT).agg(best.alias("b")).select(*SEGMENT, "b.gain", "b.threshold")


@dataclass
class Options:
    """How trees are fitted; model variants are values of this."""

    features: list[str]
    missing: dict[str, str] = field(default_factory=dict)  # feature -> indicator that it may be missing
    max_depth: int = 7
    min_leaf: int = 10
    alpha: float = 1.0
    ccp_alpha: float = 0.0001
    criterion: str = "entropy"
    min_child: int = 0
    oracle: bool = False  # treat features that may be missing as plain ones
    prune: bool = True
    lookahead_totals: str = "child"  # or "parent": whose totals a feature is looked ahead with
    times: str | None = None  # for how many samples a row stands (``alike``)


def fit(samples: DataFrame, opt: Options) -> DataFrame:
    """Fit one tree per ``tree_key``; returns the node table.

    A feature that may be missing can be used only below a node at which its indicator
    was tested false. Elsewhere it is looked ahead to: the gain of the indicator plus
    the gain of the feature among the rows whose indicator is false, less ``ccp_alpha``;
    if that wins, the node is split on the indicator. Order on ties: plain features,
    indicators, look-ahead, each as declared.
    """
    spark = samples.sparkSession
    indicators = [] if opt.oracle else sorted(set(opt.missing.values()))
    plain = opt.features if opt.oracle else [f for f in opt.features if f not in opt.missing]
    risky = [] if opt.oracle else [f for f in opt.features if f in opt.missing]
    rows = samples.withColumn("path", F.lit("R"))
    done: list[dict] = []
    live: dict[tuple[str, str], dict] = {}
    tree: dict[str, dict] = {}
    for level in range(opt.max_depth + 1):
        found = totals(rows, ["tree_key", "path"], times=opt.times).collect()  # one row per open node
        if level == 0:
            for r in found:
                alpha = opt.alpha * r["n"] / r["rows"]
                g, h = normalisers(r["n"], r["ng"], alpha)
                tree[r["tree_key"]] = {"n": r["n"], "g": g, "h": h, "alpha": alpha}
        nxt = {}
        for r in found:
            t = tree[r["tree_key"]]
            key = (r["tree_key"], r["path"])
            known = live.get((key[0], key[1][:-1]), {}).get("clear", frozenset())
            parent = live.get((key[0], key[1][:-1]))
            clear = known | ({parent["feature"]} if parent and key[1][-1] == "F" and parent["feature"] in indicators else set())
            used = (parent["used"] | {parent["feature"]}) if parent and parent["feature"] in indicators else (parent["used"] if parent else frozenset())
            node = {"tree_key": key[0], "path": key[1], "level": level, "feature": None, "op": None, "threshold": None, "value": node_value(r["ng"], r["n"], t["g"], t["h"], t["alpha"]), "n_goal": r["ng"], "n_other": r["n"] - r["ng"], "gain": None, "n": r["n"], "rows": r["rows"], "clear": frozenset(clear), "used": frozenset(used)}
            done.append(node)
            if 0 < r["ng"] < r["n"] and r["rows"] > opt.min_leaf and level < opt.max_depth:
                nxt[key] = node
        if not nxt:
            break
        small = spark.createDataFrame([(k[0], k[1], v["n"], v["n_goal"], v["rows"], tree[k[0]]["n"], tree[k[0]]["g"], tree[k[0]]["h"], tree[k[0]]["alpha"]) for k, v in nxt.items()], "tree_key string, path string, n double, ng double, rows long, tree_n double, g double, h double, alpha double")
        found_gains = split_gains(rows, small, [*plain, *risky, *indicators], opt.criterion, min_child=opt.min_child, ahead={f: opt.missing[f] for f in risky}, lookahead_totals=opt.lookahead_totals, times=opt.times)
        gains = {(r["tree_key"], r["path"], r["feature"]): (r["gain"], r["threshold"]) for r in found_gains.collect()}  # a row per open node and feature
        ahead = {(*key, f): gains[(*key, AHEAD + f)][0] for key in nxt for f in risky if (*key, AHEAD + f) in gains}
        chosen = []
        for key, node in nxt.items():
            best = (0.0, None, None)
            options = [(gains.get((*key, f), (0.0, None)), f) for f in plain]
            options += [(gains.get((*key, f), (0.0, None)), f) for f in risky if opt.missing[f] in node["clear"]]
            options += [((gains.get((*key, i), (0.0, None))[0], 0.5), i) for i in indicators if i not in node["used"]]
            options += [((gains.get((*key, opt.missing[f]), (0.0, None))[0] + ahead.get((*key, f), 0.0) - opt.ccp_alpha, 0.5), opt.missing[f]) for f in risky if opt.missing[f] not in node["used"] and (*key, f) in ahead]
            for (gain, threshold), f in options:
                if threshold is not None and gain > best[0]:
                    best = (gain, f, threshold)
            if best[1] is not None:
                node.update(feature=best[1], threshold=best[2], op="is_true" if best[1] in indicators else ">", gain=best[0])
                chosen.append((*key, best[1], best[2]))
        live.update(nxt)
        if not chosen:
            break
        picked = spark.createDataFrame(chosen, "tree_key string, path string, _f string, _t double")
        v = F.coalesce(*[F.when(F.col("_f") == f, F.col(f).cast("double")) for f in [*plain, *risky, *indicators]])
        rows = rows.join(F.broadcast(picked), ["tree_key", "path"]).withColumn("path", F.concat("path", F.when(v > F.col("_t"), "T").otherwise("F"))).drop("_f", "_t")
    return pruned(spark, done, opt.ccp_alpha, opt.prune)


def pruned(spark: SparkSession, nodes: list[dict], ccp_alpha: float, prune: bool = True) -> DataFrame:
    """The node table, unless told otherwise without splits whose gain is at most ``ccp_alpha``, deepest first, if both children are leaves; no data pass."""
    by = {(n["tree_key"], n["path"]): n for n in nodes}
    for key in sorted(by, key=lambda k: -len(k[1])) if prune else []:
        n = by.get(key)
        if n is None or n["feature"] is None:
            continue
        kids = [by.get((key[0], key[1] + s)) for s in "TF"]
        if all(k is None or k["feature"] is None for k in kids) and (n["gain"] <= ccp_alpha or any(k is None for k in kids)):
            n.update(feature=None, op=None, threshold=None, gain=None)
            for s in "TF":
                by.pop((key[0], key[1] + s), None)
    cols = [c.strip().split(" ")[0] for c in NODE_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(n[c] for c in cols) for n in by.values()], NODE_SCHEMA)


def weakest_links(nodes: DataFrame) -> DataFrame:
    """The node table with ``collapse``: the cost per leaf at and above which a split is cut off, weakest link first.

    A subtree's cost is what its splits gain for each leaf they add. One fit thus holds the
    pruned trees of all settings: that of a cost has the splits whose ``collapse`` is larger.
    """
    by = {(n["tree_key"], n["path"]): n.asDict() for n in nodes.collect()}  # as small as the trees
    splits = {k for k, n in by.items() if n["feature"] is not None}
    worth: dict[tuple[str, str], float] = {}
    floor: dict[str, float] = {}
    while splits:
        gain, count = {}, {}
        for k in sorted(splits, key=lambda k: -len(k[1])):
            kids = [(k[0], k[1] + s) for s in "TF" if (k[0], k[1] + s) in splits]
            gain[k], count[k] = by[k]["gain"] + sum(gain[c] for c in kids), 1 + sum(count[c] for c in kids)
        for tree in {k[0] for k in splits}:
            weakest = min((k for k in splits if k[0] == tree), key=lambda k: (gain[k] / count[k], len(k[1]), k[1]))
            floor[tree] = max(floor.get(tree, -math.inf), gain[weakest] / count[weakest])
            for k in [k for k in splits if k[0] == tree and k[1].startswith(weakest[1])]:
                worth[k] = floor[tree]
                splits.discard(k)
    rows = [(*(n[c] for c in nodes.columns), worth.get(k)) for k, n in by.items()]
    return nodes.sparkSession.createDataFrame(rows, T.StructType([*nodes.schema.fields, T.StructField("collapse", T.DoubleType())]))


def cut_at(links: DataFrame, costs: list[float]) -> DataFrame:
    """Node tables of all ``costs`` (``cost`` in front) from one with ``collapse``: splits that are not worth it become leaves, what was below them goes."""
    each = links.withColumn("cost", F.explode(F.array(*map(F.lit, costs))))
    gone = each.filter(F.col("feature").isNotNull() & (F.col("collapse") <= F.col("cost"))).select("cost", "tree_key", F.col("path").alias("_top"))
    below = each.join(gone, ["cost", "tree_key"]).filter(F.col("path").startswith(F.col("_top")) & (F.col("path") != F.col("_top"))).select("cost", "tree_key", "path").distinct()
    left = each.join(below, ["cost", "tree_key", "path"], "left_anti")
    leaf = F.col("feature").isNull() | (F.col("collapse") <= F.col("cost"))
    clear = [F.when(~leaf, F.col(c)).alias(c) if c in ("feature", "op", "threshold", "gain") else F.col(c) for c in links.columns if c != "collapse"]
    return left.select("cost", *clear)


def refitted(nodes: DataFrame, rows: DataFrame, alpha: float = 1.0, weight: str = "weight", goal: str = "has_goal") -> DataFrame:
    """The node table with values and counts of other rows (``tree_key``, features): each row is counted at its leaf, leaves at all nodes above them."""
    path = score_exprs(nodes, F.col("tree_key"))["path"]
    leaves = totals(rows.select("tree_key", path.alias("leaf"), weight, goal), ["tree_key", "leaf"], weight, goal)
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length("leaf")), lambda i: F.substring("leaf", 1, i)))
    counts = leaves.filter(F.col("leaf").isNotNull()).select("tree_key", prefix.alias("path"), "n", "ng", "rows").groupBy("tree_key", "path").agg(*[F.sum(c).alias(c) for c in ("n", "ng", "rows")])
    tree = counts.filter(F.col("path") == "R").select("tree_key", F.col("n").alias("_n"), F.col("ng").alias("_g"), (alpha * F.col("n") / F.col("rows")).alias("_a"))
    met = nodes.drop("n_goal", "n_other").join(counts.drop("rows"), ["tree_key", "path"], "left").join(tree, "tree_key", "left").fillna(0.0, ["n", "ng", "_n", "_g"]).fillna(alpha, ["_a"])
    a = F.col("_a")
    up = (F.col("ng") + a) * (F.col("_n") + 2 * a) / 2 / (F.col("_g") + a)
    down = (F.col("n") - F.col("ng") + a) * (F.col("_n") + 2 * a) / 2 / (F.col("_n") - F.col("_g") + a)
    return met.withColumn("value", up / (up + down)).select(*[F.col("ng").alias(c) if c == "n_goal" else (F.col("n") - F.col("ng")).alias(c) if c == "n_other" else F.col(c) for c in nodes.columns])


#: What a node's rule asks of its feature.
RULES = {
    ">": lambda v, t: v.cast("double") > t, ">=": lambda v, t: v.cast("double") >= t, "<": lambda v, t: v.cast("double") < t,
    "<=": lambda v, t: v.cast("double") <= t, "is_true": lambda v, t: v.cast("boolean"),
}


def score_exprs(nodes: DataFrame, tree_key: Column, missing: dict[str, str] | None = None, column: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Expressions over the samples, whose features are read by ``column``: ``likelihood`` and ``path`` of the leaf reached, and, with indicators, ``truncated`` (stop at a node whose feature is missing).

    A null feature takes the false branch; an unknown tree has likelihood 0.5; a rule that is
    not in ``RULES`` is an error. Only the node table, as small as the trees, is collected.
    """
    by = {(n["tree_key"], n["path"]): n for n in nodes.collect()}
    missing = missing or {}

    def walk(key: str, path: str, pick, stop: bool) -> Column:
        n = by[(key, path)]
        if n["feature"] is None:
            return pick(n)
        f = n["feature"]
        went = F.coalesce(RULES[n["op"]](column(f), n["threshold"]), F.lit(False))
        out = F.when(went, walk(key, path + "T", pick, stop)).otherwise(walk(key, path + "F", pick, stop))
        return F.when(F.coalesce(column(missing[f]), F.lit(False)), pick(n)).otherwise(out) if stop and f in missing else out

    def each(pick, stop: bool, none: Column) -> Column:
        out = none
        for key in sorted({k for k, _ in by}, reverse=True):
            out = F.when(tree_key == key, walk(key, "R", pick, stop)).otherwise(out)
        return out

    value, path = (lambda n: F.lit(float(n["value"]))), (lambda n: F.lit(n["path"]))
    return {"likelihood": each(value, False, F.lit(0.5)), "path": each(path, False, F.lit(None).cast("string")), "truncated": each(value, True, F.lit(0.5))}


def untaken(path: Column) -> Column:
    """The sibling prefixes along a path: each prefix with its last turn reversed."""
    flip = lambda i: F.concat(path.substr(F.lit(1), i), F.when(path.substr(i + 1, F.lit(1)) == "T", "F").otherwise("T"))
    return F.when(F.length(path) > 1, F.transform(F.sequence(F.lit(1), F.length(path) - 1), flip)).otherwise(F.array().cast("array<string>"))


def edges(nodes: DataFrame) -> DataFrame:
    """One row per edge: child value over parent value."""
    child = nodes.filter(F.length("path") > 1).select("tree_key", F.col("path").alias("child"), F.expr("substring(path, 1, length(path) - 1)").alias("path"), F.col("value").alias("cv"))
    return nodes.join(child, ["tree_key", "path"]).select("tree_key", "path", "child", (F.col("cv") / F.col("value")).alias("weight"))


def hand_written(spark: SparkSession) -> DataFrame:
    """A small hand-written tree table, as an example of literal nodes."""
    rows = [
        ("A", "R", 0, "f_quantity", ">", 25.0, 0.5, 0.0, 0.0, None), ("A", "RT", 1, None, None, None, 0.7, 0.0, 0.0, None), ("A", "RF", 1, "f_discount", ">", 0.05, 0.4, 0.0, 0.0, None),
        ("A", "RFT", 2, None, None, None, 0.2, 0.0, 0.0, None), ("A", "RFF", 2, None, None, None, 0.45, 0.0, 0.0, None),
        ("N", "R", 0, "f_tax", ">", 0.04, 0.5, 0.0, 0.0, None), ("N", "RT", 1, None, None, None, 0.6, 0.0, 0.0, None), ("N", "RF", 1, None, None, None, 0.3, 0.0, 0.0, None),
    ]
    return spark.createDataFrame(rows, NODE_SCHEMA)


#: Model variants: what differs is features, prior, keying and truncation, not code. Without features a likelihood is 1, so the prior alone decides.
VARIANTS = {
    "prior_only": {"features": [], "prior": "typed"},
    "uniform_prior": {"features": [], "prior": "uniform"},
    "general": {"features": ["f_quantity", "f_discount", "f_tax"], "oracle": True, "prior": "typed"},
    "occlusion_aware": {"features": ["f_quantity", "f_discount", "f_tax"], "missing": {"f_tax": "tax_missing"}, "prior": "typed"},
    "oracle": {"features": ["f_quantity", "f_discount", "f_tax"], "missing": {"f_tax": "tax_missing"}, "oracle": True, "prior": "typed"},
    "per_goal": {"features": ["f_quantity", "f_discount", "f_tax"], "oracle": True, "prior": "uniform", "key": "goal"},
    "truncated": {"features": ["f_quantity", "f_discount", "f_tax"], "oracle": True, "prior": "typed", "truncate": True},
    "no_missing_features": {"features": ["f_quantity", "f_discount"], "prior": "typed"},
}
