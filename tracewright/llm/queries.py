"""One thin query for each operator: it reads the whole tables, applies the operator and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, infill, line_rules, ppm, vector_codes, warc_zip, winnowing
from tracewright.llm.common import read, written
from tracewright.llm.licenses import scan_licenses
from tracewright.llm.mixing import label_domains, mix
from tracewright.llm.near_dedup import near_duplicates
from tracewright.llm.token_counts import count_tokens
from tracewright.llm.token_files import read_tokens, write_tokens
from tracewright.llm.toxicity import score_toxicity

BPE = "byte_bpe_50k.json"
BPE_RANKS = "byte_bpe_50k.tiktoken"
#: Tokens that each domain keeps, relative to what it has.
MIX_WEIGHTS = {"quality1_toxic0": 1.0, "quality0_toxic0": 0.5, "quality1_toxic1": 0.25, "quality0_toxic1": 0.1}


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log probability by the model of the training documents, beside the unigram base."""
    return ppm.score(read(spark, sf_dir, "documents"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, the items they are of as a digest."""
    found = winnowing.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated")
    )


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read back from the files."""
    docs = read(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, str(public_tokenizers.path(BPE)), public_tokenizers.PATTERN, end_id=2))


def op4_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity, learnt from rows out of the held-out fold."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("spans", "text_hash")


def op5_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    return warc_zip.read_records(warc_zip.write_archives(read(spark, sf_dir, "pages")))


def op6_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, counted without ids."""
    return count_tokens(read(spark, sf_dir, "documents"), str(public_tokenizers.path(BPE)), public_tokenizers.PATTERN)


def op8_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates."""
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and document rules on every text."""
    return line_rules.clean_lines(read(spark, sf_dir, "documents")).drop("kept_text", "n_failed_lines")


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domains and rate, and how far the totals are off their targets."""
    found = mix(read(spark, sf_dir, "documents"), label_domains(read(spark, sf_dir, "labels")), MIX_WEIGHTS)
    return found.select("doc_id", "n_tokens", F.to_json("posteriors").alias("posteriors"), "rate", "copies", "residual")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the rank file, and the bytes that they decode to, as digests."""
    path = str(public_tokenizers.path(BPE_RANKS))
    found = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its lines put together anew, and the text rebuilt from that, as digests."""
    found = infill.restore(infill.fill_in_middle(read(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors and those of their labels, and a digest of the codebooks."""
    codes, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    found = vector_codes.with_label_errors(written(codes, "vector-codes"))
    return found.select(
        "vec_id",
        vector_codes.code_text(F.col("code")).alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_ppm_scoring, op2_winnowing, op3_simple8b, op4_crf_toxicity, op5_zip_warc, op6_diagonal_licenses, op7_token_counts, op8_odd_sketch_dedup, op9_line_rules,
        op10_soft_mixing, op11_byte_bpe, op12_fill_in_middle, op13_filtering_lloyd,
    )
}
SQL: dict[str, str] = {
    "op2_winnowing": winnowing.SQL,
    "op5_zip_warc": warc_zip.SQL,
    "op9_line_rules": line_rules.SQL,
    "op12_fill_in_middle": infill.SQL,
    "op13_filtering_lloyd": vector_codes.SQL
}
