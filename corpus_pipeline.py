"""A training corpus from raw documents: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared folder as Parquet and reads
it again as the next one's docs. All but the last return the columns of `documents`. Rows with a null doc_id are judged by
their text where a stage judges texts, and otherwise stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.decontaminate import contamination
from ledgerline.llm.inputs import table, tokenizer
from ledgerline.llm.line_dedup import dedup_lines
from ledgerline.llm.near_dedup import near_duplicates
from ledgerline.llm.packing import pack
from ledgerline.llm.shared import staged
from ledgerline.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_uid(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumns({"id": F.col("doc_id").cast("long"), "uid": F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))})


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs that aren't in gone (doc_id, uid): rows that share an id go or stay each by its own text."""
    gone = gone.select(F.col("doc_id").alias("gone"), "uid").distinct()
    out = _with_uid(docs)
    return out.join(gone, (out["uid"] == gone["uid"]) & out["id"].eqNullSafe(F.col("gone")), "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Null and empty texts and ids are scored like any; equal rows go or stay together;
    other columns are left out; an empty table stays empty."""
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"))).where("score >= 0.7")
    return _without(docs, scored.select("doc_id", F.xxhash64("doc_id", "text").alias("uid")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; texts shrink, to nothing if all of one repeats.

    All rows stay, null texts and ids and repeated rows too; an empty table stays empty.
    """
    left = dedup_lines(docs).where("removed_words > 0").select(F.col("doc_id").alias("cut"), "uid", F.col("text").alias("left")).dropDuplicates(["cut", "uid"])
    out = _with_uid(docs)
    out = out.join(left, (out["uid"] == left["uid"]) & (out["id"] == left["cut"]), "left")
    n_chars = F.when(F.col("left").isNull(), F.col("n_chars")).otherwise(F.length("left").cast("long"))
    return out.select("doc_id", F.coalesce("left", "text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays, with all its rows of that text.

    Texts without words and rows without an id stay; an empty table stays empty.
    """
    return _without(docs, near_duplicates(docs).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark windows go, by their own text, whatever their id.

    Null and empty texts stay; an empty table stays empty.
    """
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of at most 4096. Null texts have an end id only; null and
    repeated ids are packed like any; an empty table gives an empty one."""
    return pack(docs, tokenizer("word_bpe_49k.json")[0], end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: Tokenizers and alignment have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
