"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from .bpe import op1_bpe_round_trip
from .chat import SQL_OP3, op3_chat_format
from .licenses import op7_license_scan
from .mixing import op6_mix_sources
from .near_dedup import SQL_OP10, op10_near_dedup
from .quality import op8_quality_lines
from .token_counts import op9_token_counts
from .token_files import op5_token_files
from .topk import SQL_OP2, op2_exact_topk
from .toxicity import op4_toxicity

QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_exact_topk": op2_exact_topk,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_mix_sources": op6_mix_sources,
    "op7_license_scan": op7_license_scan,
    "op8_quality_lines": op8_quality_lines,
    "op9_token_counts": op9_token_counts,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {"op2_exact_topk": SQL_OP2, "op3_chat_format": SQL_OP3, "op10_near_dedup": SQL_OP10}
