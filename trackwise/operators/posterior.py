"""From likelihoods of candidate goals to posteriors, predictions and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.functions import bucket, entropy_term, smoothed_rate, standard_error

METRICS = ["correct", "entropy_norm", "cross_entropy", "true_goal_prob"]


def with_prior(cand: DataFrame, priors: DataFrame, keys: list[str], *, default: float | None = None) -> DataFrame:
    """Attach ``prior`` by the priors' keys; a candidate without prior gets ``default`` (null in batch form, 0 online)."""
    out = cand.join(priors.select(*keys, "prior"), keys, "left")
    return out if default is None else out.withColumn("prior", F.coalesce("prior", F.lit(default)))


def uniform_prior(cand: DataFrame, sample: list[str]) -> DataFrame:
    """Give every candidate of a sample the same prior."""
    return cand.withColumn("prior", F.lit(1.0) / F.count("*").over(Window.partitionBy(*sample)))


def posterior(cand: DataFrame, sample: list[str], likelihood: str = "likelihood") -> DataFrame:
    """Add ``prob``: likelihood times prior, normalised per sample; null where the sum is null or zero."""
    u = F.nanvl(F.col(likelihood), F.lit(None).cast("double")) * F.col("prior")
    out = cand.withColumn("_u", u)
    total = F.sum("_u").over(Window.partitionBy(*sample))
    return out.withColumn("prob", F.when(total > 0, F.col("_u") / total)).drop("_u")


def summarise(probs: DataFrame, sample: list[str], keep: list[str]) -> DataFrame:
    """One row per sample: prediction (ties to the lowest goal), probabilities, entropies, cross-entropy."""
    p, goal = F.col("prob"), F.col("possible_goal")
    best = F.max_by(F.struct("possible_goal", "goal_type"), F.when(p.isNotNull(), F.struct(F.round(p, 9), -goal)))
    n, known = F.count("*"), F.count("prob")
    true_p = F.coalesce(F.max(F.when(goal == F.col("true_goal"), p)), F.lit(0.0))
    h = -F.sum(entropy_term(p, p))
    agg = probs.groupBy(*sample).agg(
        *[F.first(c).alias(c) for c in keep], F.first("true_goal").alias("true_goal"), best.alias("_best"),
        F.max("prob").alias("max_prob"), F.min("prob").alias("min_prob"), h.alias("entropy"), n.alias("n"), known.alias("_known"), true_p.alias("true_goal_prob"),
    )
    return agg.select(
        *sample, *keep, "true_goal", F.col("_best.possible_goal").alias("model_prediction"), F.col("_best.goal_type").alias("predicted_goal_type"),
        "max_prob", "min_prob", "entropy", F.when(F.col("n") > 1, F.col("entropy") / F.ln(F.col("n"))).otherwise(F.lit(0.0)).alias("entropy_norm"), "true_goal_prob",
        F.when(F.col("true_goal_prob") > 0, -F.ln("true_goal_prob") / F.col("_known")).otherwise(F.lit(0.0)).alias("cross_entropy"),
        (F.col("_best.possible_goal") == F.col("true_goal")).cast("double").alias("correct"),
    )


def compared(cand: DataFrame, sample: str, true_goal: Column, models: dict[str, tuple[str, Column]]) -> DataFrame:
    """``model n accuracy mean_true_goal_prob`` of many models: ``posterior`` and what ``summarise`` tells of each, by the column of its likelihood and its prior.

    Models stay columns of a candidate's row, so candidates are put in order once, not once a model; those dealt by ``sample`` are not shuffled.
    """
    w, goal = Window.partitionBy(sample), F.col("possible_goal")
    known = cand.select(sample, "possible_goal", *[(F.nanvl(F.col(c), F.lit(None).cast("double")) * prior).alias(f"_u{k}") for k, (c, prior) in enumerate(models.values())])
    known = known.select("*", *[F.sum(f"_u{k}").over(w).alias(f"_t{k}") for k in range(len(models))])
    probs = known.select(sample, "possible_goal", *[F.when(F.col(f"_t{k}") > 0, F.col(f"_u{k}") / F.col(f"_t{k}")).alias(f"_p{k}") for k in range(len(models))])

    def told(k: int) -> list[Column]:
        p = F.col(f"_p{k}")
        best = F.max(F.when(p.isNotNull(), F.struct(F.round(p, 9).alias("p"), (-goal).alias("goal"))))
        return [(-best["goal"] == true_goal).cast("double").alias(f"_c{k}"), F.coalesce(F.max(F.when(goal == true_goal, p)), F.lit(0.0)).alias(f"_g{k}")]

    each = probs.groupBy(sample).agg(*[c for k in range(len(models)) for c in told(k)])
    means = each.agg(F.count("*").alias("n"), *[F.avg(f"_{c}{k}").alias(f"{c}{k}") for k in range(len(models)) for c in "cg"])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), "n", F.col(f"c{k}").alias("accuracy"), F.col(f"g{k}").alias("mean_true_goal_prob")) for k, m in enumerate(models)]))
    return means.filter("n > 0").select(rows.alias("r")).select("r.*")


def curves(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and standard error of each metric by tenth of the trajectory observed, in long form."""
    long = pred.select(*keys, bucket(F.col("fraction_observed")).alias("fraction"), *METRICS).unpivot([*keys, "fraction"], METRICS, "metric", "v")
    return long.groupBy(*keys, "metric", "fraction").agg(F.avg("v").alias("mean"), standard_error(F.col("v")).alias("sem"), F.count("v").alias("n"))


def metric_table(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, entropies, mean probabilities and log loss per key."""
    p = F.col("max_prob")
    return pred.groupBy(*keys).agg(
        F.avg("correct").alias("accuracy"), standard_error(F.col("correct")).alias("accuracy_sem"), F.avg("cross_entropy").alias("cross_entropy"),
        F.avg("entropy").alias("entropy"), F.avg("entropy_norm").alias("entropy_norm"), F.avg("max_prob").alias("mean_max_prob"), F.avg("min_prob").alias("mean_min_prob"),
        F.avg("true_goal_prob").alias("mean_true_goal_prob"), F.avg(F.when(p != 0, -F.ln(p))).alias("log_loss"), F.count("*").alias("n"),
        F.sum(p.isNull().cast("long")).alias("n_undefined"),
    )


def goal_priors(agents: DataFrame, grid: DataFrame, alpha: float) -> DataFrame:
    """Smoothed share of distinct agents per cell of the configured grid; agents off the grid count in the total. Agent numbers count by the scenario and episode that ``agents`` have."""
    seen = agents.select(*[c for c in ("scenario", "episode") if c in agents.columns], "agent_id", "true_goal", "true_goal_type").distinct()
    total = seen.agg(F.count("*").alias("total"))
    counts = seen.groupBy("true_goal", "true_goal_type").agg(F.count("*").alias("c"))
    cells = grid.agg(F.count("*").alias("cells"))
    joined = grid.join(counts, ["true_goal", "true_goal_type"], "left").crossJoin(total).crossJoin(cells)  # two one-row tables
    return joined.select("true_goal", "true_goal_type", smoothed_rate(F.coalesce("c", F.lit(0)), F.col("total"), alpha, F.col("cells")).alias("prior"))


def balanced_weights(rows: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Weight every row so that all scenarios weigh the same and the mean weight is one."""
    per = rows.groupBy(scenario).agg(F.count("*").alias("_n"))
    whole = per.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(per.crossJoin(whole)), scenario).withColumn("weight", F.col("_all") / F.col("_n") / F.col("_k")).drop("_n", "_all", "_k")


def drop_low_samples(samples: DataFrame, keys: list[str], frame: str, least: int = 2) -> DataFrame:
    """Rows of keys with at least ``least`` distinct frames; in one pass, by windows over a key."""
    w = Window.partitionBy(*keys)
    known = samples.dropna(subset=keys).withColumn("_r", F.dense_rank().over(w.orderBy(F.desc_nulls_last(frame))))
    k = F.max(F.when(F.col(frame).isNotNull(), F.col("_r"))).over(w)
    return known.withColumn("_k", k).filter(F.col("_k") >= least).drop("_r", "_k")


def gained(base: DataFrame, test: DataFrame, keys: list[str], cut: float) -> DataFrame:
    """Keys whose true-goal probability under ``base`` exceeds that under ``test`` by more than ``cut``; aligned by key."""
    b = base.select(*keys, F.col("true_goal_prob").alias("_b"))
    t = test.select(*keys, F.col("true_goal_prob").alias("_t"))
    return b.join(t, keys).filter(F.col("_b") - F.col("_t") > cut).select(*keys, (F.col("_b") - F.col("_t")).alias("gain"))


def disagreeing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on which one model is right and the other wrong."""
    return a.select(*keys, F.col("correct").alias("correct_a")).join(b.select(*keys, F.col("correct").alias("correct_b")), keys).filter(F.col("correct_a") != F.col("correct_b"))


def value_shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Relative frequency of each value combination."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("_all"))).select(*keys, "n", (F.col("n") / F.col("_all")).alias("share"))


def leaking(splits: DataFrame) -> DataFrame:
    """Episodes of a scenario that stand in more than one subset."""
    return splits.groupBy("scenario", "episode").agg(F.countDistinct("subset").alias("n_subsets")).filter(F.col("n_subsets") > 1)


def r9(c: str | Column) -> Column:
    """Round for a stable comparison between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9)
