"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcela.llm.collocations import OP11_SQL, op11_collocations
from parcela.llm.filter_audit import OP12_SQL, op12_filter_audit
from parcela.llm.language_id import op13_language_id
from parcela.llm.licenses import op8_licenses
from parcela.llm.mixing import op4_mixing
from parcela.llm.packing import op7_packing
from parcela.llm.pii import op6_pii
from parcela.llm.quality_classifier import op9_quality_classifier
from parcela.llm.quality_rules import op10_quality_rules
from parcela.llm.sharding import op1_sharding
from parcela.llm.simhash import op5_simhash
from parcela.llm.topk import OP3_SQL, op3_topk
from parcela.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_topk": op3_topk,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL: dict[str, str] = {"op3_topk": OP3_SQL, "op11_collocations": OP11_SQL, "op12_filter_audit": OP12_SQL}
