"""The subpackage's registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import chat, substring, topk
from pathloom.llm.alignment import op12_alignment
from pathloom.llm.bpe import op2_bpe
from pathloom.llm.chat import op9_chat
from pathloom.llm.packing import op4_packing
from pathloom.llm.passes import op11_embedding_dedup
from pathloom.llm.quality import op3_quality
from pathloom.llm.runs import op13_runs
from pathloom.llm.secrets import op7_secrets
from pathloom.llm.simhash import op1_simhash
from pathloom.llm.substring import op6_substring
from pathloom.llm.tokencount import op8_token_counts
from pathloom.llm.tokenfiles import op5_token_files
from pathloom.llm.topk import op10_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_bpe, op3_quality, op4_packing, op5_token_files, op6_substring, op7_secrets, op8_token_counts, op9_chat, op10_topk, op11_embedding_dedup, op12_alignment, op13_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op6_substring": substring.ORACLE, "op9_chat": chat.ORACLE, "op10_topk": topk.ORACLE}
