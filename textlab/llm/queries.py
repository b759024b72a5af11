"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textlab.llm import bpe, chat, decontam, langid, minhash, pii, quality, records, repeats, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.op1,
    "op2_bpe": bpe.op2,
    "op3_chat": chat.op3,
    "op4_decontam": decontam.op4,
    "op5_pii": pii.op5,
    "op6_minhash": minhash.op6,
    "op7_toxicity": toxicity.op7,
    "op8_repeats": repeats.op8,
    "op9_quality": quality.op9,
    "op10_records": records.op10,
}

ORACLE_SQL: dict[str, str] = {"op3_chat": chat.OP3_SQL, "op8_repeats": repeats.OP8_SQL, "op9_quality": quality.OP9_SQL}
