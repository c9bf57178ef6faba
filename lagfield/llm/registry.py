"""The corpus operators' queries and SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, fertility, minhash, mixing, periodic, quality, repair_ids, sentencepiece_codec, token_counts, topk, url_filter, warc

MODULES = (quality, exact_dedup, warc, sentencepiece_codec, mixing, topk, token_counts, repair_ids, url_filter, minhash, periodic, alignment, fertility)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for m in MODULES for name, sql in m.SQL.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
