"""One thin query per text operator, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.llm import ctw, fingerprint, htmltext, jaccard, langid, lexical, manifest, packing, piecelattice, quality, sketching, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.audit(warc.from_pages(pages), warc.from_pages(warc.damaged(pages)))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecelattice.encode(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(manifest.document_leaves(_table(spark, sf_dir, "documents"), tampered=manifest.fifth()))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketching.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_html_extraction": op5_html_extraction,
    "op6_sentencepiece_lattice": op6_sentencepiece_lattice,
    "op7_packing": op7_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_ctw_scoring": op9_ctw_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES = {
    "op10_quality_rules": quality.ORACLE,
    "op11_merkle_manifest": manifest.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
