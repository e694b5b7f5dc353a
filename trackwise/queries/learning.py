"""Tree learning, scoring and audit queries over the labelled rows of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise import probes
from trackwise.operators import posterior as post
from trackwise.operators.posterior import r9
from trackwise.plans import trees
from trackwise.registry import query
from trackwise.shared import kept

T = f"t AS ({probes.TRAIN})"
FEATURES = ["f_quantity", "f_discount", "f_tax"]
MISSING = {"f_tax": "tax_missing"}
TOT = "tot AS (SELECT tree_key, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN has_goal THEN 1 ELSE 0 END) AS DOUBLE) AS ng FROM t GROUP BY tree_key)"
NORM = "nm AS (SELECT *, (n + 2) / 2 / (ng + 1) AS g, (n + 2) / 2 / (n - ng + 1) AS h FROM tot)"


def _imp(ng: str, n: str) -> str:
    p = f"(({ng} + 1) / ({n} + 2))"
    return f"(-g * {p} * ln({p}) - h * (1 - {p}) * ln(1 - {p}))"


STACK = "st AS (UNPIVOT (SELECT tree_key, has_goal, f_quantity, f_discount, f_tax FROM t) ON f_quantity, f_discount, f_tax INTO NAME feature VALUE v)"
DIST = "ds AS (SELECT tree_key, feature, v, CAST(count(*) AS DOUBLE) AS w, CAST(sum(CASE WHEN has_goal THEN 1 ELSE 0 END) AS DOUBLE) AS wg FROM st GROUP BY 1, 2, 3)"
CUM = "cu AS (SELECT *, sum(w) OVER o AS lw, sum(wg) OVER o AS lg, lead(v) OVER (PARTITION BY tree_key, feature ORDER BY v) AS nx FROM ds WINDOW o AS (PARTITION BY tree_key, feature ORDER BY v ROWS UNBOUNDED PRECEDING))"
GAIN = f"ga AS (SELECT cu.tree_key, feature, (v + nx) / 2 AS threshold, round({_imp('ng', 'n')} - lw / n * {_imp('lg', 'lw')} - (n - lw) / n * {_imp('(ng - lg)', '(n - lw)')}, 12) AS gain FROM cu JOIN nm ON nm.tree_key = cu.tree_key WHERE nx IS NOT NULL)"
SPLIT = f"{T}, {TOT}, {NORM}, {STACK}, {DIST}, {CUM}, {GAIN}, sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_key, feature ORDER BY gain DESC, threshold) AS rn FROM ga) WHERE rn = 1)"


@query(f"WITH {T}, {TOT}, {NORM} SELECT tree_key, n, ng, round((ng + 1) * g / ((ng + 1) * g + (n - ng + 1) * h), 9) AS value, round({_imp('ng', 'n')}, 9) AS impurity FROM nm")
def node_values(spark: SparkSession, sf: str) -> DataFrame:
    """O-32, O-100: root value (one half by construction) and impurity of every tree."""
    t = trees.totals(probes.train(spark, sf), ["tree_key"])
    n, ng, one = F.col("n"), F.col("ng"), F.lit(1.0)
    g, h = (n + 2) / 2 / (ng + 1), (n + 2) / 2 / (n - ng + 1)
    value = (ng + 1) * g / ((ng + 1) * g + (n - ng + 1) * h)
    return t.select("tree_key", "n", "ng", r9(value).alias("value"), r9(trees.impurity_expr(ng, n, g, h, one)).alias("impurity"))


@query(f"WITH {SPLIT} SELECT tree_key, feature, round(gain, 9) AS gain, round(threshold, 9) AS threshold FROM sp")
def best_root_splits(spark: SparkSession, sf: str) -> DataFrame:
    """O-101: exact best threshold of every tree and feature at the root."""
    rows = probes.train(spark, sf).withColumn("path", F.lit("R"))
    t = trees.totals(rows, ["tree_key", "path"])
    n, ng = F.col("n"), F.col("ng")
    nodes = t.select("tree_key", "path", "n", "ng", "rows", n.alias("tree_n"), ((n + 2) / 2 / (ng + 1)).alias("g"), ((n + 2) / 2 / (n - ng + 1)).alias("h"), F.lit(1.0).alias("alpha"))
    return trees.split_gains(rows, nodes, FEATURES).select("tree_key", "feature", r9("gain").alias("gain"), r9("threshold").alias("threshold"))


_STUMP = """f AS (SELECT tree_key, feature, threshold, gain FROM (SELECT *, row_number() OVER (PARTITION BY tree_key ORDER BY gain DESC, CASE feature WHEN 'f_quantity' THEN 0 WHEN 'f_discount' THEN 1 ELSE 2 END) AS r2 FROM sp) WHERE r2 = 1 AND gain > 0),
k AS (SELECT t.tree_key, CASE WHEN (CASE feature WHEN 'f_quantity' THEN f_quantity WHEN 'f_discount' THEN f_discount ELSE f_tax END) > threshold THEN 'RT' ELSE 'RF' END AS path, count(*) AS n, CAST(sum(CASE WHEN has_goal THEN 1 ELSE 0 END) AS DOUBLE) AS ng FROM t JOIN f ON f.tree_key = t.tree_key GROUP BY 1, 2)"""


@query(f"""WITH {SPLIT}, {_STUMP}
SELECT nm.tree_key, 'R' AS path, feature, round(threshold, 9) AS threshold, round((ng + 1) * g / ((ng + 1) * g + (n - ng + 1) * h), 9) AS value FROM nm LEFT JOIN f ON f.tree_key = nm.tree_key
UNION ALL SELECT k.tree_key, path, NULL, NULL, round((k.ng + 1) * g / ((k.ng + 1) * g + (k.n - k.ng + 1) * h), 9) FROM k JOIN nm ON nm.tree_key = k.tree_key""")
def fitted_stumps(spark: SparkSession, sf: str) -> DataFrame:
    """O-102 at depth one, unpruned, which SQL can express whole."""
    nodes = trees.fit(probes.train(spark, sf), trees.Options(FEATURES, max_depth=1, ccp_alpha=-1.0))
    return nodes.select("tree_key", "path", "feature", r9("threshold").alias("threshold"), r9("value").alias("value"))


def _aware(**over) -> trees.Options:
    return trees.Options(**({"features": FEATURES, "missing": MISSING, "max_depth": 4, "ccp_alpha": 0.0001} | over))


COLUMNS = ["tree_key", "path", "level", "feature", "op", "threshold", "value", "n_goal", "n_other", "gain"]


def fit_sql(p: str, source: str, features: list[str], *, missing: dict[str, str] | None = None, depth: int, criterion: str = "entropy", min_leaf: int = 10, min_child: int = 0, ccp: float = 0.0001, pruned: bool = True) -> str:
    """A tree fit as SQL, one group of tables a level under the prefix ``p``: the fitted nodes are ``{p}nodes``.

    ``source`` has tree_key, has_goal, the features and at most one indicator that a feature may be missing.
    """
    missing = missing or {}
    ind = next(iter(missing.values()), None)
    plain, risky = [f for f in features if f not in missing], [f for f in features if f in missing]

    def imp(ng: str, n: str) -> str:
        if criterion == "entropy":
            return _imp(f"({ng})", f"({n})")
        q = f"(({ng}) * g / (({ng}) * g + (({n}) - ({ng})) * h))"
        return f"CASE WHEN ({ng}) * g + (({n}) - ({ng})) * h > 0 THEN 2 * {q} * (1 - {q}) ELSE 0 END"

    out = [
        f"{p}r0 AS (SELECT *, 'R' AS path, false AS clear, false AS used FROM {source})",
        f"{p}tk AS (SELECT *, (tn + 2) / 2 / (tg + 1) AS g, (tn + 2) / 2 / (tn - tg + 1) AS h FROM (SELECT tree_key, CAST(count(*) AS DOUBLE) AS tn, CAST(count(*) FILTER (has_goal) AS DOUBLE) AS tg FROM {p}r0 GROUP BY tree_key))",
    ]
    for k in range(depth + 1):
        out.append(f"{p}n{k} AS (SELECT tree_key, path, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (has_goal) AS DOUBLE) AS ng, any_value(clear) AS clear, any_value(used) AS used FROM {p}r{k} WHERE length(path) = {k + 1} GROUP BY 1, 2)")
        if k == depth:
            break
        stacks = [f"SELECT tree_key, path, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, has_goal FROM {p}r{k} WHERE length(path) = {k + 1}" for f in [*plain, *risky, *([ind] if ind else [])]]
        stacks += [f"SELECT tree_key, path, 'ahead/{f}', CAST({f} AS DOUBLE), has_goal FROM {p}r{k} WHERE length(path) = {k + 1} AND NOT {ind}" for f in risky]
        look = "feature LIKE 'ahead/%'"
        seg = "PARTITION BY d.tree_key, d.path, feature"
        out += [
            f"{p}ds{k} AS (SELECT tree_key, path, feature, v, CAST(count(*) AS DOUBLE) AS w, CAST(count(*) FILTER (has_goal) AS DOUBLE) AS wg FROM ({' UNION ALL '.join(stacks)}) GROUP BY ALL)",
            f"{p}cu{k} AS (SELECT d.*, sum(w) OVER ({seg} ORDER BY v) AS lw, sum(wg) OVER ({seg} ORDER BY v) AS lg, lead(v) OVER ({seg} ORDER BY v) AS nx, CASE WHEN {look} THEN sum(w) OVER ({seg}) ELSE o.n END AS nn, CASE WHEN {look} THEN sum(wg) OVER ({seg}) ELSE o.ng END AS nng, tn, g, h FROM {p}ds{k} d JOIN {p}n{k} o ON o.tree_key = d.tree_key AND o.path = d.path AND o.ng > 0 AND o.ng < o.n AND o.n > {min_leaf} JOIN {p}tk t ON t.tree_key = d.tree_key)",
            f"{p}sp{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_key, path, feature ORDER BY gain DESC, threshold) AS rn FROM (SELECT *, (v + nx) / 2 AS threshold, round(nn / tn * ({imp('nng', 'nn')} - lw / nn * {imp('lg', 'lw')} - (nn - lw) / nn * {imp('nng - lg', 'nn - lw')}), 12) AS gain FROM {p}cu{k} WHERE nx IS NOT NULL AND lw >= {min_child} AND nn - lw >= {min_child})) WHERE rn = 1)",
        ]
        options = [f"SELECT tree_key, path, feature, threshold, gain, {i} AS ord FROM {p}sp{k} WHERE feature = '{f}'" for i, f in enumerate(plain)]
        own = f"JOIN {p}n{k} o USING (tree_key, path)"
        options += [f"SELECT tree_key, path, feature, threshold, gain, {100 + i} FROM {p}sp{k} {own} WHERE feature = '{f}' AND o.clear" for i, f in enumerate(risky)]
        if ind:
            options.append(f"SELECT tree_key, path, feature, 0.5, gain, 200 FROM {p}sp{k} {own} WHERE feature = '{ind}' AND NOT o.used")
        options += [f"SELECT a.tree_key, a.path, '{ind}', 0.5, coalesce(i.gain, 0) + a.gain - {ccp}, {300 + j} FROM {p}sp{k} a JOIN {p}n{k} o ON o.tree_key = a.tree_key AND o.path = a.path AND NOT o.used LEFT JOIN {p}sp{k} i ON i.tree_key = a.tree_key AND i.path = a.path AND i.feature = '{ind}' WHERE a.feature = 'ahead/{f}'" for j, f in enumerate(risky)]
        value = " ".join(f"WHEN '{f}' THEN CAST({f} AS DOUBLE)" for f in [*features, *([ind] if ind else [])])
        chosen = f"c.feature = '{ind}'" if ind else "false"
        out += [
            f"{p}ch{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_key, path ORDER BY gain DESC, ord) AS rn FROM ({' UNION ALL '.join(options)}) WHERE gain > 0) WHERE rn = 1)",
            f"{p}r{k + 1} AS (SELECT r.* REPLACE (CASE WHEN c.feature IS NULL THEN r.path WHEN (CASE c.feature {value} END) > c.threshold THEN r.path || 'T' ELSE r.path || 'F' END AS path, r.clear OR coalesce({chosen} AND NOT (CASE c.feature {value} END) > c.threshold, false) AS clear, r.used OR coalesce({chosen}, false) AS used) FROM {p}r{k} r LEFT JOIN {p}ch{k} c ON c.tree_key = r.tree_key AND c.path = r.path)",
        ]
    node = f"SELECT n.tree_key, n.path, CAST({{k}} AS INT) AS level, {{f}}, n.ng AS n_goal, n.n - n.ng AS n_other, (n.ng + 1) * g / ((n.ng + 1) * g + (n.n - n.ng + 1) * h) AS value FROM {p}n{{k}} n JOIN {p}tk t ON t.tree_key = n.tree_key"
    out.append(f"{p}f{depth} AS ({node.format(k=depth, f='CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS gain')})")
    for k in range(depth - 1, -1, -1):
        dropped = f"c.gain <= {ccp} AND NOT EXISTS (SELECT 1 FROM {p}f{k + 1} z WHERE z.tree_key = n.tree_key AND z.path[:-2] = n.path AND z.feature IS NOT NULL)" if pruned else "false"
        each = ", ".join(f"CASE WHEN {dropped} THEN NULL ELSE c.{c} END AS {c}" for c in ("feature", "threshold", "gain"))
        out.append(f"{p}f{k} AS ({node.format(k=k, f=each)} LEFT JOIN {p}ch{k} c ON c.tree_key = n.tree_key AND c.path = n.path)")
    out.append(f"{p}e0 AS (SELECT * FROM {p}f0)")
    out += [f"{p}e{k} AS (SELECT f.* FROM {p}f{k} f JOIN {p}e{k - 1} e ON e.tree_key = f.tree_key AND e.path = f.path[:-2] AND e.feature IS NOT NULL)" for k in range(1, depth + 1)]
    rule = f"CASE WHEN feature = '{ind}' THEN 'is_true' WHEN feature IS NOT NULL THEN '>' END" if ind else "CASE WHEN feature IS NOT NULL THEN '>' END"
    out.append(f"{p}nodes AS (SELECT *, {rule} AS op FROM ({' UNION ALL '.join(f'SELECT * FROM {p}e{k}' for k in range(depth + 1))}))")
    return ", ".join(out)


def walk_sql(p: str, rows: str, nodes: str, features: list[str], depth: int, stop: dict[str, str] | None = None) -> str:
    """Rows with the value and path of the leaf they reach in a node table, as ``{p}leaf``; with ``stop``, of the node whose feature is missing. An unknown tree has no path and 0.5."""
    value = " ".join(f"WHEN '{f}' THEN CAST({f} AS DOUBLE)" for f in features)
    ends = "".join(f" WHEN e.feature = '{f}' AND {i} THEN w.walked" for f, i in (stop or {}).items())
    out = [f"{p}w0 AS (SELECT *, 'R' AS walked FROM {rows})"]
    out += [f"{p}w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN e.feature IS NULL THEN walked{ends} WHEN (CASE e.feature {value} END) > e.threshold THEN walked || 'T' ELSE walked || 'F' END AS walked) FROM {p}w{k} w LEFT JOIN {nodes} e ON e.tree_key = w.tree_key AND e.path = w.walked AND length(w.walked) = {k + 1})" for k in range(depth)]
    out.append(f"{p}leaf AS (SELECT w.*, coalesce(e.value, 0.5) AS likelihood FROM {p}w{depth} w LEFT JOIN {nodes} e ON e.tree_key = w.tree_key AND e.path = w.walked)")
    return ", ".join(out)


def cut_sql(p: str, nodes: str, depth: int, costs: list[float]) -> str:
    """The best subtree of a node table for each cost of a split, bottom up, as ``{p}cut``: a split stays if what it and the splits below it gain is more than they cost."""
    out = [f"{p}c AS (SELECT unnest({costs}) AS cost)", f"{p}g{depth} AS (SELECT cost, tree_key, path, 0.0 AS worth FROM {nodes}, {p}c WHERE level = {depth})"]
    for k in range(depth - 1, -1, -1):
        out.append(f"{p}g{k} AS (SELECT cost, n.tree_key, n.path, CASE WHEN n.feature IS NULL THEN 0.0 ELSE greatest(0.0, n.gain - cost + coalesce((SELECT sum(z.worth) FROM {p}g{k + 1} z WHERE z.cost = c.cost AND z.tree_key = n.tree_key AND z.path[:-2] = n.path), 0)) END AS worth FROM {nodes} n, {p}c c WHERE n.level = {k})")
    out.append(f"{p}h0 AS (SELECT cost, n.*, worth > 1e-13 AS stays FROM {nodes} n JOIN {p}g0 USING (tree_key, path))")
    out += [f"{p}h{k} AS (SELECT g.cost, n.*, g.worth > 1e-13 AS stays FROM {nodes} n JOIN {p}g{k} g USING (tree_key, path) JOIN {p}h{k - 1} u ON u.cost = g.cost AND u.tree_key = n.tree_key AND u.path = n.path[:-2] AND u.stays)" for k in range(1, depth + 1)]
    blank = ", ".join(f"CASE WHEN stays THEN {c} END AS {c}" for c in ("feature", "op", "threshold", "gain"))
    out.append(f"{p}cut AS (SELECT cost, tree_key, path, level, n_goal, n_other, value, {blank} FROM ({' UNION ALL '.join(f'SELECT * FROM {p}h{k}' for k in range(depth + 1))}))")
    return ", ".join(out)


_NODES = "tree_key, path, level, feature, op, round(threshold, 9) AS threshold, round(value, 9) AS value, n_goal, n_other, round(gain, 9) AS gain"


def _rounded(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select(*more, *[r9(c).alias(c) if c in ("threshold", "value", "gain") else F.col(c) for c in COLUMNS])


@query(f"WITH {T}, {fit_sql('a', 't', FEATURES, missing=MISSING, depth=4)} SELECT {_NODES} FROM anodes")
def fitted_occlusion_aware_trees(spark: SparkSession, sf: str) -> DataFrame:
    """O-102, O-103: look-ahead over the indicator, four levels, pruned."""
    return _rounded(trees.fit(probes.train(spark, sf), _aware()))


_PER_GOAL = "tg AS (SELECT * REPLACE (tree_key || '/' || goal AS tree_key) FROM t)"
_SOME = "tt AS (SELECT * FROM tg WHERE sample_id % 4 <> 0)"
_COST = 0.002
_REFIT = """lp AS (SELECT tree_key, walked AS leaf, has_goal, unnest(range(1, length(walked) + 1)) AS i FROM bleaf),
cn AS (SELECT tree_key, leaf[:i] AS path, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (has_goal) AS DOUBLE) AS ng FROM lp GROUP BY 1, 2), rt AS (SELECT tree_key, n AS tn, ng AS tg FROM cn WHERE path = 'R'),
rf AS (SELECT c.* REPLACE (coalesce(cn.ng, 0) AS n_goal, coalesce(cn.n, 0) - coalesce(cn.ng, 0) AS n_other, (coalesce(ng, 0) + 1) * (tn + 2) / 2 / (tg + 1) / ((coalesce(ng, 0) + 1) * (tn + 2) / 2 / (tg + 1) + (coalesce(n, 0) - coalesce(ng, 0) + 1) * (tn + 2) / 2 / (tn - tg + 1)) AS value) FROM kcut c LEFT JOIN cn USING (tree_key, path) LEFT JOIN rt USING (tree_key))"""


@query(f"WITH {T}, {_PER_GOAL}, {_SOME}, {fit_sql('b', 'tt', FEATURES, depth=3, criterion='gini', min_child=10, pruned=False)}, {cut_sql('k', 'bnodes', 3, [_COST])}, {walk_sql('b', 'tg', 'kcut', FEATURES, 3)}, {_REFIT} SELECT {_NODES} FROM rf")
def fitted_balanced_trees(spark: SparkSession, sf: str) -> DataFrame:
    """O-104: gini, children of ten rows or more, one tree per goal and type; cut by cost and complexity; values of other rows than those fitted on."""
    rows = probes.train(spark, sf).withColumn("tree_key", F.concat_ws("/", "tree_key", F.col("goal").cast("string")))
    grown = trees.fit(rows.filter("sample_id % 4 <> 0"), _aware(criterion="gini", min_child=10, oracle=True, max_depth=3, ccp_alpha=-1.0))
    return _rounded(trees.refitted(trees.cut_at(trees.weakest_links(grown), [_COST]).drop("cost"), rows))


def _variant(name: str) -> dict:
    return {"missing": {}, "oracle": False, "key": None, "truncate": False} | trees.VARIANTS[name]


def _variant_sql(name: str) -> str:
    """Candidates of a variant with their likelihood, as ``v_{name}``."""
    v, p = _variant(name), name
    mean = f"v_{p} AS (SELECT '{name}' AS variant, '{v['prior']}' AS prior_kind, sample_id, goal, min(kind) AS kind, avg(likelihood) AS likelihood FROM {{rows}} GROUP BY sample_id, goal)"
    if not v["features"]:
        return mean.format(rows="(SELECT *, tree_key AS kind, 1.0 AS likelihood FROM t)")
    key = f"tree_key || '/' || {v['key']}" if v["key"] else "tree_key"
    missing = {} if v["oracle"] else v["missing"]
    fitted = fit_sql(p, f"{p}t", v["features"], missing=missing, depth=2)
    walked = walk_sql(p, f"{p}t", f"{p}nodes", [*v["features"], *missing.values()], 2, MISSING if v["truncate"] else None)
    return f"{p}t AS (SELECT * REPLACE ({key} AS tree_key), tree_key AS kind FROM t), {fitted}, {walked}, {mean.format(rows=f'{p}leaf')}"


_ALL = " UNION ALL ".join(f"SELECT * FROM v_{n}" for n in sorted(trees.VARIANTS))


@query(f"""WITH {T}, {', '.join(_variant_sql(n) for n in sorted(trees.VARIANTS))}, al AS ({_ALL}), tp AS (SELECT tree_key AS kind, count(*) FILTER (has_goal) * 1.0 / sum(count(*) FILTER (has_goal)) OVER () AS share FROM t GROUP BY 1),
u AS (SELECT al.*, likelihood * CASE prior_kind WHEN 'typed' THEN share ELSE 1.0 / count(*) OVER (PARTITION BY variant, sample_id) END AS u FROM al JOIN tp USING (kind)), q AS (SELECT *, u / sum(u) OVER (PARTITION BY variant, sample_id) AS prob FROM u),
m AS (SELECT variant, sample_id, goal, prob, goal = sample_id % 7 + 1 AS is_true, row_number() OVER (PARTITION BY variant, sample_id ORDER BY round(prob, 9) DESC, goal) AS rn FROM q)
SELECT variant, count(*) FILTER (rn = 1) AS n, round(avg(CASE WHEN rn = 1 THEN CASE WHEN is_true THEN 1.0 ELSE 0.0 END END), 9) AS accuracy, round(sum(CASE WHEN is_true THEN prob ELSE 0 END) / count(*) FILTER (rn = 1), 9) AS mean_true_goal_prob FROM m GROUP BY variant""")
def fitted_model_variants(spark: SparkSession, sf: str) -> DataFrame:
    """O-110, O-119, O-120: every variant's likelihood as a column of one pass, its prior applied, and its posterior's accuracy and mean true-goal probability."""
    rows = probes.train(spark, sf)
    same = kept(trees.alike(rows, ["tree_key", "goal", *FEATURES, *MISSING.values(), "has_goal"]))
    fits, likelihood = {}, {}
    for name in sorted(trees.VARIANTS):
        v = _variant(name)
        if not v["features"]:
            likelihood[name] = F.lit(1.0)
            continue
        keyed = lambda goal, v=v: F.concat_ws("/", "tree_key", F.col(goal).cast("string")) if v["key"] else F.col("tree_key")
        missing = {} if v["oracle"] else v["missing"]
        options = (v["key"], *v["features"], *missing)  # variants that differ in scoring or priors share a fit
        if options not in fits:
            fits[options] = kept(trees.fit(same.withColumn("tree_key", keyed(v["key"])), _aware(features=v["features"], missing=missing, max_depth=2, times="times")))
        likelihood[name] = trees.score_exprs(fits[options], keyed(v["key"]), MISSING)["truncated" if v["truncate"] else "likelihood"]
    means = rows.select("sample_id", F.col("goal").alias("possible_goal"), "tree_key", *[c.alias(n) for n, c in likelihood.items()]).repartition("sample_id")
    means = means.groupBy("sample_id", "possible_goal").agg(F.min("tree_key").alias("goal_type"), *[F.avg(n).alias(n) for n in likelihood])
    typed = same.groupBy(F.col("tree_key").alias("goal_type")).agg(F.sum(F.when(F.col("has_goal"), F.col("times")).otherwise(0)).cast("double").alias("k"))
    share = typed.crossJoin(typed.agg(F.sum("k").alias("all"))).select("goal_type", (F.col("k") / F.col("all")).alias("typed"))  # a one-row table
    cand = post.uniform_prior(means, ["sample_id"]).join(F.broadcast(share), "goal_type")
    models = {n: (n, F.col("typed") if _variant(n)["prior"] == "typed" else F.col("prior")) for n in likelihood}
    told = post.compared(cand, "sample_id", (F.col("sample_id") % 7 + 1).cast("int"), models)
    return told.select(F.col("model").alias("variant"), "n", r9("accuracy").alias("accuracy"), r9("mean_true_goal_prob").alias("mean_true_goal_prob"))


_HAND = """CASE tree_key WHEN 'A' THEN CASE WHEN f_quantity > 25 THEN 'RT' WHEN f_discount > 0.05 THEN 'RFT' ELSE 'RFF' END WHEN 'N' THEN CASE WHEN f_tax > 0.04 THEN 'RT' ELSE 'RF' END END"""
_HAND_VALUE = "CASE tree_key || path WHEN 'ART' THEN 0.7 WHEN 'ARFT' THEN 0.2 WHEN 'ARFF' THEN 0.45 WHEN 'NRT' THEN 0.6 WHEN 'NRF' THEN 0.3 ELSE 0.5 END"


@query(f"""WITH {T}, p AS (SELECT *, {_HAND} AS path FROM t)
SELECT tree_key, path, CAST({_HAND_VALUE} AS DOUBLE) AS likelihood, CAST(CASE WHEN tree_key = 'N' AND tax_missing THEN 0.5 ELSE {_HAND_VALUE} END AS DOUBLE) AS truncated, count(*) AS n FROM p GROUP BY 1, 2, 3, 4""")
def scored_by_hand_written_trees(spark: SparkSession, sf: str) -> DataFrame:
    """O-105, O-106, O-107, O-109, O-119, O-121: value, truncated value and path; tree R is unknown."""
    e = trees.score_exprs(trees.hand_written(spark), F.col("tree_key"), MISSING)
    return probes.train(spark, sf).select("tree_key", *[e[k].alias(k) for k in ("path", "likelihood", "truncated")]).groupBy("tree_key", "path", "likelihood", "truncated").agg(F.count("*").alias("n"))


@query(f"""WITH {T}, p AS (SELECT *, {_HAND} AS path FROM t), e AS (SELECT tree_key, unnest(CASE WHEN length(path) = 2 THEN [CASE path WHEN 'RT' THEN 'RF' ELSE 'RT' END] WHEN length(path) = 3 THEN ['RT', CASE path WHEN 'RFT' THEN 'RFF' ELSE 'RFT' END] ELSE [] END) AS prefix FROM p)
SELECT tree_key, prefix, count(*) AS n FROM e GROUP BY 1, 2""")
def untaken_branches(spark: SparkSession, sf: str) -> DataFrame:
    """O-107: how often each branch was passed by."""
    path = trees.score_exprs(trees.hand_written(spark), F.col("tree_key"))["path"]
    rows = probes.train(spark, sf).select("tree_key", path.alias("path")).filter(F.col("path").isNotNull())
    return rows.select("tree_key", F.explode(trees.untaken(F.col("path"))).alias("prefix")).groupBy("tree_key", "prefix").agg(F.count("*").alias("n"))


@query(f"""WITH {SPLIT}, {_STUMP}
SELECT k.tree_key, 'R' AS path, path AS child, round(((k.ng + 1) * g / ((k.ng + 1) * g + (k.n - k.ng + 1) * h)) / ((nm.ng + 1) * g / ((nm.ng + 1) * g + (nm.n - nm.ng + 1) * h)), 9) AS weight FROM k JOIN nm ON nm.tree_key = k.tree_key""")
def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    """O-108."""
    nodes = trees.fit(probes.train(spark, sf), trees.Options(FEATURES, max_depth=1, ccp_alpha=-1.0))
    return trees.edges(nodes).withColumn("weight", r9("weight"))


def _posterior(rows: DataFrame, likelihood) -> DataFrame:
    """Candidates with a likelihood to one row per sample."""
    c = rows.groupBy("sample_id", F.col("goal").alias("possible_goal")).agg(F.min("tree_key").alias("goal_type"), F.avg(likelihood).alias("likelihood"))
    c = c.withColumn("true_goal", (F.col("sample_id") % 7 + 1).cast("int"))
    return post.summarise(post.posterior(post.uniform_prior(c, ["sample_id"]), ["sample_id"]), ["sample_id"], [])


COSTS = [0.0, 0.0001, 0.001, 0.01]
_ONE_COST = "kk AS (SELECT * REPLACE (tree_key || '/' || cost AS tree_key) FROM kcut), tc AS (SELECT t.* REPLACE (tree_key || '/' || cost AS tree_key), tree_key AS kind, cost FROM t, (SELECT DISTINCT cost FROM kcut))"


@query(f"""WITH {T}, {fit_sql('a', 't', FEATURES, missing=MISSING, depth=3, ccp=0.0, pruned=False)}, {cut_sql('k', 'anodes', 3, COSTS)}, {_ONE_COST}, {walk_sql('s', 'tc', 'kk', [*FEATURES, 'tax_missing'], 3)},
m AS (SELECT cost, kind, avg(likelihood) FILTER (has_goal) AS m FROM sleaf GROUP BY 1, 2) SELECT CAST(cost AS DOUBLE) AS ccp_alpha, round(avg(m), 9) AS mean_goal_likelihood FROM m GROUP BY 1""")
def pruning_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """O-111: one fit; the trees of all settings are cuts of it by weakest links; mean of per-key means."""
    rows = probes.train(spark, sf)
    cuts = trees.cut_at(trees.weakest_links(trees.fit(rows, _aware(ccp_alpha=0.0, max_depth=3, prune=False))), COSTS)
    keyed = cuts.withColumn("tree_key", F.concat_ws("/", "tree_key", F.col("cost").cast("string"))).drop("cost")
    cost = F.explode(F.array(*map(F.lit, COSTS)))
    each = rows.withColumn("ccp_alpha", cost)
    lk = trees.score_exprs(keyed, F.concat_ws("/", "tree_key", F.col("ccp_alpha").cast("string")))["likelihood"]
    per = each.groupBy("ccp_alpha", "tree_key").agg(F.avg(F.when(F.col("has_goal"), lk)).alias("m"))
    return per.groupBy("ccp_alpha").agg(r9(F.avg("m")).alias("mean_goal_likelihood"))


_FOLDS = "fo AS (SELECT t.* REPLACE (tree_key || '/' || held AS tree_key) FROM t, (SELECT unnest(range(4)) AS held) WHERE sample_id % 4 <> held), te AS (SELECT * REPLACE (tree_key || '/' || sample_id % 4 AS tree_key), CAST(sample_id % 4 AS VARCHAR) AS fold FROM t)"


@query(f"""WITH {T}, {_FOLDS}, {fit_sql('a', 'fo', FEATURES, missing=MISSING, depth=2)}, {walk_sql('s', 'te', 'anodes', [*FEATURES, 'tax_missing'], 2)}
SELECT fold, round(avg(likelihood) FILTER (has_goal), 9) AS goal_likelihood, round(avg(likelihood) FILTER (NOT has_goal), 9) AS other_likelihood, count(*) AS n FROM sleaf GROUP BY fold""")
def leave_one_out_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """O-112: the fold is part of the tree key, so all folds are fitted in the same jobs; each is scored on its held-out rows."""
    rows = probes.train(spark, sf).withColumn("fold", (F.col("sample_id") % 4).cast("string"))
    folds = F.explode(F.filter(F.array(*[F.lit(str(i)) for i in range(4)]), lambda held: held != F.col("fold")))
    training = rows.withColumn("held_out", folds).withColumn("tree_key", F.concat_ws("/", "tree_key", "held_out"))
    lk = trees.score_exprs(trees.fit(training, _aware(max_depth=2)), F.concat_ws("/", "tree_key", "fold"))["likelihood"]
    return rows.groupBy("fold").agg(r9(F.avg(F.when(F.col("has_goal"), lk))).alias("goal_likelihood"), r9(F.avg(F.when(~F.col("has_goal"), lk))).alias("other_likelihood"), F.count("*").alias("n"))


def _true_prob(name: str, leaf: str) -> str:
    """The true goal's probability of each sample under uniform priors, 0 if it is no candidate."""
    return f"{name}0 AS (SELECT sample_id, goal, avg(likelihood) AS lk FROM {leaf} GROUP BY 1, 2), {name} AS (SELECT sample_id, coalesce(sum(lk) FILTER (goal = sample_id % 7 + 1) / sum(lk), 0) AS p FROM {name}0 GROUP BY 1)"


@query(f"""WITH {T}, {fit_sql('a', 't', FEATURES, missing=MISSING, depth=2)}, {walk_sql('x', 't', 'anodes', [*FEATURES, 'tax_missing'], 2)}, {fit_sql('b', 't', FEATURES[:2], depth=2)}, {walk_sql('y', 't', 'bnodes', FEATURES[:2], 2)},
{_true_prob('px', 'xleaf')}, {_true_prob('py', 'yleaf')}, won AS (SELECT t.* FROM t JOIN px USING (sample_id) JOIN py USING (sample_id) WHERE px.p - py.p > 0.0001), {fit_sql('c', 'won', FEATURES, missing=MISSING, depth=2)} SELECT {_NODES} FROM cnodes""")
def significant_subset_study(spark: SparkSession, sf: str) -> DataFrame:
    """O-113: fit with and without the feature that may be missing, keep the samples that gain, refit on them."""
    rows = probes.train(spark, sf)
    full = trees.score_exprs(trees.fit(rows, _aware(max_depth=2)), F.col("tree_key"))["likelihood"]
    bare = trees.score_exprs(trees.fit(rows, _aware(features=FEATURES[:2], missing={}, max_depth=2)), F.col("tree_key"))["likelihood"]
    won = post.gained(_posterior(rows, full), _posterior(rows, bare), ["sample_id"], 0.0001)
    return _rounded(trees.fit(rows.join(won.select("sample_id"), "sample_id", "left_semi"), _aware(max_depth=2)))


@query(f"""WITH {T}, p AS (SELECT *, {_HAND} AS path FROM t), v AS (SELECT *, {_HAND_VALUE} AS a, CASE tree_key WHEN 'A' THEN CASE WHEN f_quantity > 25 THEN 0.7 WHEN f_discount + 0.02 > 0.05 THEN 0.2 ELSE 0.45 END WHEN 'N' THEN CASE WHEN f_tax > 0.04 THEN 0.6 ELSE 0.3 END ELSE 0.5 END AS b FROM p)
SELECT 'a higher discount never raises the likelihood' AS proposition, count(*) AS n, CAST(sum(CASE WHEN b > a THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM v
UNION ALL SELECT 'a higher discount never lowers the likelihood', count(*), CAST(sum(CASE WHEN b < a THEN 1 ELSE 0 END) AS BIGINT) FROM v""")
def counterfactual_audit(spark: SparkSession, sf: str) -> DataFrame:
    """O-114: score every sample with one field overridden and count violations; evidence from data, not a proof."""
    lk = trees.score_exprs(trees.hand_written(spark), F.col("tree_key"))["likelihood"]
    both = probes.train(spark, sf).withColumn("a", lk).withColumn("f_discount", F.col("f_discount") + 0.02).withColumn("b", lk)
    one = lambda text, bad: both.agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("violations")).select(F.lit(text).alias("proposition"), "n", "violations")
    return one("a higher discount never raises the likelihood", F.col("b") > F.col("a")).union(one("a higher discount never lowers the likelihood", F.col("b") < F.col("a")))
