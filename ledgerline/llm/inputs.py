"""Input tables and vocabularies of the queries."""

from __future__ import annotations

import json
from pathlib import Path

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> tuple[str, int]:
    """(file's text, number of ids) of a tokenizers file."""
    text = Path(public_tokenizers.path(name)).read_text()
    parts = json.loads(text)
    return text, 1 + max([*parts["model"]["vocab"].values(), *(t["id"] for t in parts["added_tokens"])])


def pieces(name: str) -> list[str]:
    """A sentencepiece file's pieces in id order, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
