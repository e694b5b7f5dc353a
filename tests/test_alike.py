"""Many samples that are alike count once in a fit, and many models are compared in one pass."""

from pyspark.sql import functions as F

from trackwise import probes
from trackwise.operators import posterior as post
from trackwise.plans import trees

SF = "/root/testdata/sf0.001"
FEATURES, MISSING = ["f_quantity", "f_discount", "f_tax"], {"f_tax": "tax_missing"}


def test_fit_over_alike_rows_is_that_over_samples(spark):
    rows = probes.train(spark, SF).withColumn("f_quantity", F.floor(F.col("f_quantity") / 10)).withColumn("f_tax", F.when(F.col("f_quantity") != 2, F.col("f_tax")))
    same = trees.alike(rows, ["tree_key", *FEATURES, "tax_missing", "has_goal"])
    assert same.count() < rows.count()
    for over in ({}, {"min_child": 20, "criterion": "gini"}):
        opt = {"features": FEATURES, "missing": MISSING, "max_depth": 2, "ccp_alpha": -1.0} | over
        a, b = (sorted(map(str, trees.fit(r, trees.Options(**opt, times=t)).collect())) for r, t in ((rows, None), (same, "times")))
        assert a == b and len(a) > 3


def test_models_compared_in_one_pass(spark):
    r = [(s, g, "AN"[g % 2], (s * g % 5) / 5, None if s == 4 else float((s + g) % 3)) for s in range(1, 9) for g in range(1, 4)]
    cand = spark.createDataFrame([*r, (9, 1, "A", float("nan"), 0.0)], "sample_id long, possible_goal int, goal_type string, m double, other double")
    true = (F.col("sample_id") % 3 + 1).cast("int")
    cand = post.uniform_prior(cand, ["sample_id"]).withColumn("typed", F.when(F.col("goal_type") == "A", 0.7).otherwise(0.3))
    got = {x.model: tuple(x)[1:] for x in post.compared(cand, "sample_id", true, {"m": ("m", F.col("prior")), "other": ("other", F.col("typed"))}).collect()}
    for model, prior in (("m", "prior"), ("other", "typed")):
        told = post.summarise(post.posterior(cand.withColumn("prior", F.col(prior)).withColumn("true_goal", true), ["sample_id"], model), ["sample_id"], [])
        want = told.agg(F.count("*"), F.avg("correct"), F.avg("true_goal_prob")).first()
        assert got[model][0] == want[0] and all(abs(a - b) < 1e-12 for a, b in zip(got[model][1:], want[1:], strict=True))
