"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hmm, language, licenses, mixing, near_text, near_vectors, pii, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": language.op1,
    "op10_suffixes": suffixes.op10,
    "op2_toxicity": toxicity.op2,
    "op3_hmm": hmm.op3,
    "op4_pii": pii.op4,
    "op5_mixing": mixing.op5,
    "op6_near_vectors": near_vectors.op6,
    "op7_near_text": near_text.op7,
    "op8_licenses": licenses.op8,
    "op9_decontaminate": decontaminate.op9,
}

SQL: dict[str, str] = {
    "op10_suffixes": suffixes.SQL10,
    "op6_near_vectors": near_vectors.SQL6,
    "op7_near_text": near_text.SQL7,
    "op8_licenses": licenses.SQL8,
    "op9_decontaminate": decontaminate.SQL9,
}
