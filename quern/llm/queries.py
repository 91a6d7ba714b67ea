"""Queries of this package for the driver's contract, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.byte_bpe import op8_byte_bpe
from quern.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from quern.llm.line_dedup import op5_line_dedup
from quern.llm.mixing import op2_mixing
from quern.llm.quality import OP9_SQL, op9_quality_rules
from quern.llm.sharding import OP1_SQL, op1_sharding
from quern.llm.simhash import op10_simhash
from quern.llm.token_files import op4_token_files
from quern.llm.tool_calls import OP7_SQL, op7_tool_calls
from quern.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_token_files": op4_token_files,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_tool_calls": op7_tool_calls,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op1_sharding": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op6_warc": OP6_SQL, "op7_tool_calls": OP7_SQL, "op9_quality_rules": OP9_SQL}
