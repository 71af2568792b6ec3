"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, bpe, mixing, pii, qda, records, rules, sharding, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_pii": pii.op6_pii,
    "op7_token_records": records.op7_token_records,
    "op8_multi_index_hashing": ann.op8_multi_index_hashing,
    "op9_quality_classifier": qda.op9_quality_classifier,
    "op10_sharding": sharding.op10_sharding,
}


def __getattr__(name: str):
    """``ORACLES`` is made when it is asked for, as the sharding table is filled for it."""
    if name == "ORACLES":
        return {"op1_warc": warc.ORACLE, "op5_quality_rules": rules.ORACLE, "op10_sharding": sharding.oracle()}
    raise AttributeError(name)
