"""The queries opN_<name> over the training tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, codes, collisions, fmindex, html, jaccard, lm, maxscore, negatives, quality, sql, substrings, toxicity, urls
from tessera.storage import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", F.col("quality").alias("score"), (F.col("quality") >= quality.KEEP).alias("keep"))


def op3_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.train(urls.labelled_urls(spark)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", "removed", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.report(fmindex.find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


def op12_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.neighbours(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), negatives.label_of())


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_classifier, op3_maxscore_search, op4_url_filter, op5_substring_dedup, op6_ngram_jaccard_join, op7_html_extraction, op8_brown_lm, op9_benchmark_decontamination, op10_bpe, op11_vector_codes, op12_collision_counting, op13_hard_negatives)}
SQL: dict[str, str] = {"op3_maxscore_search": maxscore.SQL, "op6_ngram_jaccard_join": jaccard.SQL, "op9_benchmark_decontamination": sql.OP9, "op11_vector_codes": codes.sql(), "op13_hard_negatives": negatives.SQL}
