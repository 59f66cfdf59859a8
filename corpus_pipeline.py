"""The corpus pipeline: documents through five operators, each stage a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainlake.llm import decontaminate, language, mixing, near_text, pii
from chainlake.llm.common import read_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language.stage),
    ("near_duplicates", near_text.stage),
    ("decontamination", decontaminate.stage),
    ("personal_data", pii.stage),
    ("mixing", mixing.stage),
]

#: SQL can express neither the classifier nor the network; tests/llm holds each stage against its plain counterpart.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what the stages keep of `documents`: their rows, with how often each is taken."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
