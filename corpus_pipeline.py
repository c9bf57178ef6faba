"""From raw documents to token ids: the corpus operators as stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagfield.llm import exact_dedup, minhash, mixing, quality, sentencepiece_codec
from lagfield.llm.common import Scratch, read, tables_of

STAGES = [
    ("quality classifier", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("MinHash near-dedup", minhash.stage),
    ("mixing sources to target weights", mixing.stage),
    ("SentencePiece encoding and decoding", sentencepiece_codec.stage),
]

#: The classifier, the sketches and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. Tables of steps, and of earlier stages, go once the next stage's is written."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with tables_of() as steps:
            docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for made in steps:
            made.remove()
        scratch.clear(name.replace(" ", "-"))
    return docs
