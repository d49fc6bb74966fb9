"""The subpackage's queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.decontamination import OP9_SQL, op9_decontamination
from glyphmill.llm.line_dedup import op1_line_dedup
from glyphmill.llm.mixing import OP4_SQL, op4_mixing
from glyphmill.llm.quality_model import op2_quality_model
from glyphmill.llm.quality_rules import OP3_SQL, op3_quality_rules
from glyphmill.llm.sharding import op6_sharding
from glyphmill.llm.simhash import op10_simhash
from glyphmill.llm.substring_dedup import op5_substring_dedup
from glyphmill.llm.token_store import op7_token_store
from glyphmill.llm.toxicity import op8_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality_model": op2_quality_model,
        "op3_quality_rules": op3_quality_rules,
        "op4_mixing": op4_mixing,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_sharding": op6_sharding,
        "op7_token_store": op7_token_store,
        "op8_toxicity": op8_toxicity,
        "op9_decontamination": op9_decontamination,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op4_mixing": OP4_SQL, "op9_decontamination": OP9_SQL}
