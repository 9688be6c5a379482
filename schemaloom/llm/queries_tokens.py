"""Queries of byte-level BPE and of token-id files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm import byte_bpe, token_files
from schemaloom.llm.tables import read

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op5_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    model = byte_bpe.encoder(public_tokenizers.path(ranks), public_tokenizers.PATTERN)
    return byte_bpe.digests(read(spark, sf_dir, "documents"), model)


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as file:
        model = token_files.LibraryEncoder(file.read(), public_tokenizers.PATTERN, encode_special_tokens=False)
    return token_files.round_trip(read(spark, sf_dir, "documents"), model)


QUERIES = {"op5_byte_bpe": op5_byte_bpe, "op6_token_files": op6_token_files}
ORACLES: dict[str, str] = {}
