"""Query op12: tokens of all documents, and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decode, encode, read_ranks
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(spark, public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, "text", ranks, public_tokenizers.PATTERN).drop("text"), "tokens", ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("tokens") / 4).cast("bigint").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
