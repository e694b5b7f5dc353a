"""Posterior, evaluation and set-operation queries over the candidate table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise import probes
from trackwise.operators import posterior as op
from trackwise.operators.posterior import r9
from trackwise.registry import query
from trackwise.shared import kept

SAMPLE = ["scenario", "sample_id"]
#: Priors by goal type; one type has none, so its probability is undefined.
PRIORS = "SELECT * FROM (VALUES ('A', 0.5), ('N', 0.3)) AS p(goal_type, prior)"
C = f"c AS ({probes.CAND})"


def _pred_sql(likelihood: str, prior: str, name: str) -> str:
    """CTEs ``{name}_p`` (probabilities) and ``{name}`` (one row per sample)."""
    src = f"SELECT c.*, {likelihood} AS lk, {prior} AS prior FROM c" if prior != "typed" else f"SELECT c.*, {likelihood} AS lk, CAST(p.prior AS DOUBLE) AS prior FROM c LEFT JOIN ({PRIORS}) p ON p.goal_type = c.goal_type"
    return f"""{name}_u AS (SELECT *, lk * prior AS u FROM ({src})),
{name}_p AS (SELECT *, CASE WHEN sum(u) OVER w > 0 THEN u / sum(u) OVER w END AS prob FROM {name}_u WINDOW w AS (PARTITION BY scenario, sample_id)),
{name}_s AS (SELECT scenario, sample_id, min(fraction_observed) AS fraction_observed, min(true_goal) AS true_goal, max(prob) AS max_prob, min(prob) AS min_prob,
  -sum(CASE WHEN prob = 0 THEN 0.0 ELSE prob * ln(prob) END) AS entropy, count(*) AS n, count(prob) AS known, coalesce(max(CASE WHEN possible_goal = true_goal THEN prob END), 0.0) AS true_goal_prob FROM {name}_p GROUP BY scenario, sample_id),
{name}_b AS (SELECT scenario, sample_id, possible_goal, goal_type FROM (SELECT *, row_number() OVER (PARTITION BY scenario, sample_id ORDER BY round(prob, 9) DESC, possible_goal) AS rn FROM {name}_p WHERE prob IS NOT NULL) WHERE rn = 1),
{name} AS (SELECT s.*, b.possible_goal AS model_prediction, b.goal_type AS predicted_goal_type, CASE WHEN n > 1 THEN entropy / ln(n) ELSE 0.0 END AS entropy_norm,
  CASE WHEN true_goal_prob > 0 THEN -ln(true_goal_prob) / known ELSE 0.0 END AS cross_entropy, CAST(b.possible_goal = s.true_goal AS DOUBLE) AS correct
  FROM {name}_s s LEFT JOIN {name}_b b ON b.scenario = s.scenario AND b.sample_id = s.sample_id)"""


ONE_BY_N = "1.0 / count(*) OVER (PARTITION BY scenario, sample_id)"
UNIFORM = _pred_sql("likelihood", ONE_BY_N, "m1")
SECOND = _pred_sql("likelihood2", ONE_BY_N, "m2")
TYPED = _pred_sql("likelihood", "typed", "mt")


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    return op.summarise(op.posterior(op.uniform_prior(probes.cand(spark, sf), SAMPLE), SAMPLE), SAMPLE, ["fraction_observed"])


def _both(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of both models, named in ``model``, from one pass over the candidates."""
    rest = [*SAMPLE, "possible_goal", "goal_type", "true_goal", "fraction_observed"]
    key = ["model", *SAMPLE]
    name = F.when(F.col("model") == "likelihood", "first").otherwise("second")
    stacked = probes.cand(spark, sf).unpivot(rest, ["likelihood", "likelihood2"], "model", "lk").withColumn("model", name)
    return op.summarise(op.posterior(op.uniform_prior(stacked, key), key, "lk"), key, ["fraction_observed"])


def _two(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The predictions of each model, read from one written table."""
    both = kept(_both(spark, sf).select("model", *SAMPLE, "true_goal_prob", "correct"))
    return [both.filter(F.col("model") == m) for m in ("first", "second")]


@query(f"WITH {C}, {TYPED} SELECT scenario, sample_id, possible_goal, round(prior, 9) AS prior, round(prob, 9) AS prob FROM mt_p")
def posterior_with_type_priors(spark: SparkSession, sf: str) -> DataFrame:
    """O-54, O-63."""
    probs = op.posterior(op.with_prior(probes.cand(spark, sf), spark.sql(PRIORS).withColumn("prior", F.col("prior").cast("double")), ["goal_type"]), SAMPLE)
    return probs.select(*SAMPLE, "possible_goal", r9("prior").alias("prior"), r9("prob").alias("prob"))


@query(f"""WITH {C}, {TYPED} SELECT scenario, sample_id, true_goal, model_prediction, predicted_goal_type, round(max_prob, 9) AS max_prob, round(min_prob, 9) AS min_prob,
round(entropy, 9) AS entropy, round(entropy_norm, 9) AS entropy_norm, round(true_goal_prob, 9) AS true_goal_prob, round(cross_entropy, 9) AS cross_entropy FROM mt""")
def posterior_summary(spark: SparkSession, sf: str) -> DataFrame:
    """O-64, with undefined candidates."""
    priors = spark.sql(PRIORS).withColumn("prior", F.col("prior").cast("double"))
    pred = op.summarise(op.posterior(op.with_prior(probes.cand(spark, sf), priors, ["goal_type"]), SAMPLE), SAMPLE, ["fraction_observed"])
    return pred.select(*SAMPLE, "true_goal", "model_prediction", "predicted_goal_type", *[r9(c).alias(c) for c in ("max_prob", "min_prob", "entropy", "entropy_norm", "true_goal_prob", "cross_entropy")])


@query(f"""WITH {C}, {UNIFORM}, l AS (UNPIVOT (SELECT scenario, CAST(round_even(fraction_observed, 1) AS DOUBLE) AS fraction, correct, entropy_norm, cross_entropy, true_goal_prob FROM m1)
ON correct, entropy_norm, cross_entropy, true_goal_prob INTO NAME metric VALUE v)
SELECT scenario, metric, fraction, round(avg(v), 9) AS mean, CASE WHEN count(v) > 1 THEN round(stddev_samp(v) / sqrt(count(v)), 9) END AS sem, count(v) AS n FROM l GROUP BY 1, 2, 3""")
def curves_by_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """O-34, O-69, the flagship: curves by fraction of the trajectory observed."""
    c = op.curves(_pred(spark, sf), ["scenario"])
    return c.select("scenario", "metric", "fraction", r9("mean").alias("mean"), r9("sem").alias("sem"), "n")


_TABLE = ["accuracy", "accuracy_sem", "cross_entropy", "entropy", "entropy_norm", "mean_max_prob", "mean_min_prob", "mean_true_goal_prob", "log_loss"]


@query(f"""WITH {C}, {UNIFORM}, {SECOND}, b AS (SELECT 'first' AS model, * FROM m1 UNION ALL SELECT 'second' AS model, * FROM m2)
SELECT model, scenario, round(avg(correct), 9) AS accuracy, round(stddev_samp(correct) / sqrt(count(correct)), 9) AS accuracy_sem, round(avg(cross_entropy), 9) AS cross_entropy,
round(avg(entropy), 9) AS entropy, round(avg(entropy_norm), 9) AS entropy_norm, round(avg(max_prob), 9) AS mean_max_prob, round(avg(min_prob), 9) AS mean_min_prob,
round(avg(true_goal_prob), 9) AS mean_true_goal_prob, round(avg(CASE WHEN max_prob <> 0 THEN -ln(max_prob) END), 9) AS log_loss, count(*) AS n, CAST(sum(CASE WHEN max_prob IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_undefined
FROM b GROUP BY model, scenario""")
def metrics_by_model_and_scenario(spark: SparkSession, sf: str) -> DataFrame:
    """O-68."""
    t = op.metric_table(_both(spark, sf), ["model", "scenario"])
    return t.select("model", "scenario", *[r9(c).alias(c) for c in _TABLE], "n", "n_undefined")


_AGENTS = "SELECT DISTINCT sample_id AS agent_id, true_goal, goal_type AS true_goal_type FROM c WHERE possible_goal = true_goal"
_GRID = "SELECT g AS true_goal, t AS true_goal_type FROM (VALUES (1), (2), (3), (4), (5)) AS a(g), (VALUES ('A'), ('N'), ('R')) AS b(t)"


@query(f"""WITH {C}, a AS ({_AGENTS}), g AS ({_GRID})
SELECT g.true_goal, g.true_goal_type, round((coalesce(k.c, 0) + 1.0) / ((SELECT count(*) FROM a) + 1.0 * (SELECT count(*) FROM g)), 9) AS prior
FROM g LEFT JOIN (SELECT true_goal, true_goal_type, count(*) AS c FROM a GROUP BY 1, 2) k ON k.true_goal = g.true_goal AND k.true_goal_type = g.true_goal_type""")
def smoothed_goal_priors(spark: SparkSession, sf: str) -> DataFrame:
    """O-65."""
    probes.cand(spark, sf).createOrReplaceTempView("c")
    out = op.goal_priors(spark.sql(_AGENTS), spark.sql(_GRID), 1.0)
    return out.withColumn("prior", F.round("prior", 9))


_WEIGHTS = "SELECT scenario, goal_type, (SELECT count(*) FROM c) * 1.0 / count(*) OVER (PARTITION BY scenario) / (SELECT count(DISTINCT scenario) FROM c) AS weight FROM c"


@query(f"WITH {C}, w AS ({_WEIGHTS}) SELECT goal_type AS true_goal_type, round(sum(weight), 3) AS weighted, round(1.0 / count(*) OVER (), 9) AS uniform FROM w GROUP BY goal_type")
def type_priors_from_balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    """O-66, O-67."""
    w = op.balanced_weights(kept(probes.cand(spark, sf).select("scenario", "goal_type"))).groupBy(F.col("goal_type").alias("true_goal_type")).agg(F.round(F.sum("weight"), 3).alias("weighted"))
    return w.crossJoin(w.agg(F.count("*").alias("k"))).select("true_goal_type", "weighted", F.round(F.lit(1.0) / F.col("k"), 9).alias("uniform"))


@query(f"WITH {C} SELECT scenario, sample_id, possible_goal FROM c WHERE sample_id IN (SELECT sample_id FROM c GROUP BY scenario, sample_id HAVING count(DISTINCT possible_goal) >= 2)")
def drop_low_sample_agents(spark: SparkSession, sf: str) -> DataFrame:
    """O-42, O-71."""
    return op.drop_low_samples(probes.cand(spark, sf), SAMPLE, "possible_goal").select(*SAMPLE, "possible_goal").distinct()


@query(f"WITH {C}, {UNIFORM}, {SECOND} SELECT m1.scenario, m1.sample_id, round(m1.true_goal_prob - m2.true_goal_prob, 9) AS gain FROM m1 JOIN m2 ON m1.scenario = m2.scenario AND m1.sample_id = m2.sample_id WHERE m1.true_goal_prob - m2.true_goal_prob > 0.0123")
def significant_gains(spark: SparkSession, sf: str) -> DataFrame:
    """O-43, by key."""
    return op.gained(*_two(spark, sf), SAMPLE, 0.0123).withColumn("gain", r9("gain"))


@query(f"WITH {C}, {UNIFORM}, {SECOND} SELECT m1.scenario, m1.sample_id, m1.correct AS correct_a, m2.correct AS correct_b FROM m1 JOIN m2 ON m1.scenario = m2.scenario AND m1.sample_id = m2.sample_id WHERE m1.correct <> m2.correct")
def model_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """O-44, O-61."""
    return op.disagreeing(*_two(spark, sf), SAMPLE)


@query(f"""WITH {C}, {UNIFORM}, {SECOND}, a AS (SELECT sample_id FROM m1 WHERE correct = 1), b AS (SELECT sample_id FROM m2 WHERE correct = 1)
SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def agents_across_runs(spark: SparkSession, sf: str) -> DataFrame:
    """O-98."""
    a, b = (m.filter(F.col("correct") == 1).select("sample_id") for m in _two(spark, sf))
    count = lambda d, s: d.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return count(a.intersect(b), "both").union(count(a.subtract(b), "first only")).union(count(b.subtract(a), "second only"))


_SPLIT = "SELECT scenario, CASE WHEN sample_id % 5 < 3 THEN 'train' WHEN sample_id % 5 = 3 THEN 'valid' ELSE 'test' END AS subset, sample_id % 10 AS episode FROM c UNION ALL SELECT 'F' AS scenario, 'test' AS subset, sample_id % 4 AS episode FROM c WHERE sample_id % 1000 = 3"


@query(f"WITH {C}, s AS ({_SPLIT}) SELECT scenario, CAST(sum(CASE WHEN subset = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN subset = 'valid' THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN subset = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test FROM s GROUP BY scenario")
def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    """O-70, O-97."""
    probes.cand(spark, sf).createOrReplaceTempView("c")
    return spark.sql(_SPLIT).groupBy("scenario").pivot("subset", ["train", "valid", "test"]).count().na.fill(0)


@query(f"WITH {C}, s AS ({_SPLIT}) SELECT scenario, episode, count(DISTINCT subset) AS n_subsets FROM s GROUP BY scenario, episode HAVING count(DISTINCT subset) > 1")
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """O-06, O-74."""
    probes.cand(spark, sf).createOrReplaceTempView("c")
    return op.leaking(spark.sql(_SPLIT))


@query(f"WITH t AS ({probes.TRAIN}) SELECT tree_key, round(avg(CAST(tax_missing AS INT)), 9) AS missing_rate FROM t GROUP BY tree_key")
def indicator_rates(spark: SparkSession, sf: str) -> DataFrame:
    """O-72."""
    return probes.train(spark, sf).groupBy("tree_key").agg(F.round(F.avg(F.col("tax_missing").cast("int")), 9).alias("missing_rate"))


@query(f"WITH {C}, {UNIFORM} SELECT scenario, correct, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 9) AS share FROM m1 GROUP BY scenario, correct")
def value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """O-73."""
    return op.value_shares(_pred(spark, sf), ["scenario", "correct"]).withColumn("share", F.round("share", 9))


@query(f"""WITH {C}, {UNIFORM}, f AS (SELECT DISTINCT scenario AS held_out FROM c)
SELECT f.held_out, count(*) AS n_train, round(avg(m1.true_goal_prob), 9) AS train_true_goal_prob FROM f JOIN m1 ON m1.scenario <> f.held_out GROUP BY f.held_out""")
def leave_one_scenario_out(spark: SparkSession, sf: str) -> DataFrame:
    """O-99: all folds in one pass; the folds are few, the rows meet them by broadcast."""
    pred = _pred(spark, sf)
    folds = pred.select(F.col("scenario").alias("held_out")).distinct()
    met = pred.join(F.broadcast(folds), F.col("scenario") != F.col("held_out"))
    return met.groupBy("held_out").agg(F.count("*").alias("n_train"), r9(F.avg("true_goal_prob")).alias("train_true_goal_prob"))
