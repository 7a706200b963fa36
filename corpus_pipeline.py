"""A training corpus from documents: five stages, each applying one operator to all that the stage before it kept.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.mixing import label_domains, mix
from tracewright.llm.near_dedup import near_duplicates
from tracewright.llm.queries import BPE, MIX_WEIGHTS
from tracewright.llm.token_files import read_tokens, write_tokens
from tracewright.llm.toxicity import score_toxicity
from tracewright.llm.winnowing import decontaminate

#: The stages are models, iterations and files: SQL cannot express them. Tests compare each stage's rows with brute force or, for
#: the two learnt models, with their operator's verdicts.
ORACLE_SQL = None


def _joined(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """docs (as d) joined to verdicts (as v: doc_id, text_hash and more) on id and text; whatever columns docs have, none clashes.

    By merging: a broadcast table of such keys takes 64 MB of the driver's heap, however few its rows are.
    """
    text = F.xxhash64(F.coalesce(F.col("d.text"), F.lit("")))
    return docs.alias("d").join(
        verdicts.hint("merge").alias("v"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("v.doc_id")) & (text == F.col("v.text_hash")), how
    )


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger predicts to be toxic go.

    Null and empty texts have no toxic token and stay. Repeated rows share their verdict. Rows that share an id, null ids
    too, are judged by their texts. Without labels of both marks nothing goes; an empty table stays empty.
    """
    found = score_toxicity(docs, common.read(spark, sf_dir, "labels"))
    return _joined(docs, found.where(F.col("predicted") == 1).select("doc_id", "text_hash").distinct(), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays (a similarity of 0.80 or more links).

    Rows equal in id and text are one document. Texts without words are linked with nothing and stay. A null id gives way to
    any other in its group; where a group has no id at all, rows with different texts stay. Of rows that share the least id
    all texts stay.
    """
    found = near_duplicates(docs, percent=80).where("kept").select("doc_id", "text_hash").distinct()
    return _joined(docs.dropDuplicates(["doc_id", "text"]), found, "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go.

    Texts without words stay, repeated rows share their verdict, and an empty benchmark takes nothing.
    """
    found = decontaminate(docs, common.read(spark, sf_dir, "benchmark"))
    return _joined(docs, found.where(F.col("n_hit") > 0).select("doc_id", "text_hash").distinct(), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as its rate says.

    Texts without words have rate 1 and stay once; repeated rows have one rate and stand so often each. Without labels every
    rate is 1.
    """
    found = mix(docs, label_domains(common.read(spark, sf_dir, "labels")), MIX_WEIGHTS)
    rates = found.groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies")).where(F.col("copies") > 0)
    copies = rates.select("doc_id", "text_hash", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return _joined(docs, copies, "inner").select("d.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as Simple-8b shards, and each document's place in them as read back.

    A null or empty text is its end id alone. Rows of one id stand in the order of their texts, null ids first; an empty
    table writes no shard.
    """
    return read_tokens(write_tokens(docs, str(public_tokenizers.path(BPE)), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files)
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
