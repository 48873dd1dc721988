"""The thin queries over the test tables, one for each operator, and SQL for
those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.token_counts import token_counts
    return token_counts(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", limit=2048)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.ngram_model import lm_scores
    return lm_scores(_table(spark, sf_dir, "documents"), folds=10, order=3)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.simhash import simhash_groups
    return simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, distance=3, seed=42)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.suffix_dedup import suffix_dedup
    return suffix_dedup(_table(spark, sf_dir, "documents"), window=200, keep_first=False)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.fingerprints import fingerprints
    return fingerprints(_table(spark, sf_dir, "documents"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.sharding import category_code, hilbert_shards, log_code
    docs = _table(spark, sf_dir, "documents")
    bits = 5
    return hilbert_shards(docs, [category_code(docs["lang"], bits), category_code(docs["source"], bits), log_code(docs["n_chars"], bits)], bits, 16)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.packing import pack_documents
    return pack_documents(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=1, capacity=2048)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.toxicity import toxicity
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.substring_dedup import substring_repeats
    return substring_repeats(_table(spark, sf_dir, "documents"), window=13)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.decontaminate import contaminated, split_items
    items = _table(spark, sf_dir, "benchmark")
    return contaminated(_table(spark, sf_dir, "documents"), items, *split_items(items))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.resampling import resample
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ngrams=(1, 1), buckets=10_000, min_words=20, percent=10, seed=2024)


def turned(doc_id: Column, text: Column) -> Column:
    """The text that op12's contract has searched: where the id's checksum ends in 0,
    the words from some place on repeat; a null id changes nothing."""
    def bound(value: Column, body: Callable[[Column], Column]) -> Column:  # computed once, not for each word
        return F.get(F.transform(F.array(value), body), 0)

    def places(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = h_tenth % n
        return F.struct(w.alias("words"), a.alias("a"), (1 + F.floor((n - a) / (3 + h_tenth % 8)).cast("long")).alias("p"))

    def turn(s: Column) -> Column:
        return F.array_join(F.transform(s["words"], lambda x, i: F.when(i < s["a"], x).otherwise(F.get(s["words"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " ")

    h = F.crc32(doc_id.cast("string").cast("binary"))
    h_tenth = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    changed = bound(words, lambda w: F.when(F.size(w) > 0, bound(places(w), turn)))
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.periodic_runs import periodic_runs, run_digests
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", turned(docs["doc_id"], docs["text"]).alias("text"))
    return run_digests(periodic_runs(docs, min_length=6, exponent=4))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shopsight.llm.quality_rules import quality
    found = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_lm_scores": op2_lm_scores,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_resampling": op11_resampling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {}
