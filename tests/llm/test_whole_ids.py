from pyspark.sql import functions as F

from trackwise.llm import queries


def test_op6_gives_every_documents_ids(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.op6_sentencepiece_lattice(spark, sf).select("doc_id", "n_tokens", "round_trip", F.size("ids").alias("k"))
    got = out.agg(F.count("*"), F.sum((F.col("k") == F.col("n_tokens")).cast("int")), F.sum(F.col("round_trip").cast("int"))).first()
    assert got[0] == got[1] == got[2] == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_op6_shuffles_neither_segments_nor_ids(spark):
    out = queries.op6_sentencepiece_lattice(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
