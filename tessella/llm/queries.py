"""The numbered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.alignment import op12_token_alignment
from tessella.llm.conversations import OP11_SQL, op11_conversation_repair
from tessella.llm.decontamination import OP8_SQL, op8_benchmark_decontamination
from tessella.llm.licenses import op6_license_rules
from tessella.llm.lines import OP13_SQL, op13_bloom_lines
from tessella.llm.minhash import OP3_SQL, op3_minhash_tensored
from tessella.llm.personal import op4_skip_chain
from tessella.llm.pieces import op10_piece_sampling
from tessella.llm.repeats import op5_induced_suffixes
from tessella.llm.token_records import op2_token_records
from tessella.llm.toxicity import op9_toxicity_compression
from tessella.llm.vectors import OP7_SQL, op7_projection_forest
from tessella.llm.warc import OP1_SQL, op1_warc_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_chunks,
        op2_token_records,
        op3_minhash_tensored,
        op4_skip_chain,
        op5_induced_suffixes,
        op6_license_rules,
        op7_projection_forest,
        op8_benchmark_decontamination,
        op9_toxicity_compression,
        op10_piece_sampling,
        op11_conversation_repair,
        op12_token_alignment,
        op13_bloom_lines,
    )
}
ORACLE_SQL: dict[str, str] = {"op7_projection_forest": OP7_SQL, "op1_warc_chunks": OP1_SQL, "op3_minhash_tensored": OP3_SQL, "op8_benchmark_decontamination": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op13_bloom_lines": OP13_SQL}
