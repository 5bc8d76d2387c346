"""Corpus preparation: the stages, in order, and their composition."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.byte_bpe import decode_ids, encode_documents
from spanforge.llm.common import materialize, table
from spanforge.llm.language_mixture import UNDETERMINED, held_out, learn, with_language
from spanforge.llm.line_frequency import drop_site_boilerplate
from spanforge.llm.poisson_mix import mix_sources
from spanforge.llm.shingle_copies import drop_near_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; the others' lang becomes the predicted one."""
    model = learn(docs.where(~held_out()))
    found = with_language(docs, model)
    return found.where(F.col("lang_pred") != UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a page count once here, as the next stage still has to keep one of them with its text."""
    return drop_site_boilerplate(docs, copies_once=True).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies stays: five-word shingles at similarity 0.8, as a stage of its own takes them (op7 has other parameters)."""
    return drop_near_copies(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and whether the ids decode to the text again; a row for each row of docs."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    encoded = materialize(encode_documents(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids", digest), "bpe-ids")
    return decode_ids(encoded, path).select(
        "doc_id",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("BPE", tokenise),
]

#: SQL can't express the stages of language ID, SimHash and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
