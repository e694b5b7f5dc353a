"""Clashing names, and the corpus pipeline stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackwise.llm import packing, quality


def test_keep_good_with_clashing_names(spark):
    names = ["__row", "_row", "_id", "_text", "_host", "_gone", "n_words", "removed_words"]
    text = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, "a", 3, *names), (2, "few words", "a", 9, *names)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    got = quality.keep_good(docs).collect()
    assert [r.doc_id for r in got] == [1] and got[0]["__row"] == "__row" and got[0]["n_words"] == "n_words"


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    def prose(lang, seed, n=60):
        stock = {"en": ["the", "house", "which", "stands", "there", "with", "thing"], "de": ["das", "haus", "nicht", "schön", "über", "straße", "und"]}[lang]
        return " ".join(stock[(seed * 7 + k * (k + seed)) % len(stock)] + str((seed * 31 + k * k) % 97) for k in range(n))

    rows = [(k, prose("en" if k % 2 else "de", k), "en" if k % 2 else "de", f"s{k % 3}", 0) for k in range(120)]
    copy = rows[4][1].split(" ")
    rows += [(500, rows[3][1], "en", "s0", 0), (501, " ".join([*copy[:-1], "changed"]), "de", "s1", 0), (502, None, None, None, None), (503, "", "en", "s0", 0), (504, "too short", "en", "s0", 0), (505, "rep eat " * 40, "en", "s0", 0), (506, "12 34 56 78 90 " * 1 + " ".join(str(k) for k in range(1000, 1040)), None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        ids.append({r.doc_id for r in kept.collect()})
    assert set(range(120)) <= ids[0] and not ids[0] & {502, 503, 504, 505} and {500, 501} <= ids[0]
    assert 506 not in ids[1] and set(range(120)) | {500, 501} <= ids[1]  # numbers have no language
    assert not ids[2] & {500, 501} and set(range(120)) <= ids[2]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids[2]
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert whole.filter("n <> all").count() == 0
    assert sorted(map(tuple, out.groupBy("sequence_id").agg(F.sum("length").alias("n")).select((F.col("n") <= packing.WINDOW if hasattr(packing, "WINDOW") else F.col("n") <= 4096).alias("fits")).distinct().collect())) == [(True,)]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
