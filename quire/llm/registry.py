"""Queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from .chat import OP5_SQL, op5_rotate_perspectives
from .decontam import op1_find_leaks
from .followup import OP12_SQL, op12_missing_follow_ups
from .htmlmain import op10_extract_main
from .mixing import OP2_SQL, op2_mix_sources
from .ngramjoin import OP4_SQL, op4_jaccard_components
from .passages import OP9_SQL, op9_repeated_passages
from .pii import OP3_SQL, op3_find_pii
from .quality import op6_judge_quality
from .tokencount import op13_count_tokens
from .urlrep import OP8_SQL, op8_url_reputation
from .vectors import OP7_SQL, op7_top_k
from .whiten import op11_whiten

QUERIES = {
    "op1_find_leaks": op1_find_leaks,
    "op2_mix_sources": op2_mix_sources,
    "op3_find_pii": op3_find_pii,
    "op4_jaccard_components": op4_jaccard_components,
    "op5_rotate_perspectives": op5_rotate_perspectives,
    "op6_judge_quality": op6_judge_quality,
    "op7_top_k": op7_top_k,
    "op8_url_reputation": op8_url_reputation,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_extract_main": op10_extract_main,
    "op11_whiten": op11_whiten,
    "op12_missing_follow_ups": op12_missing_follow_ups,
    "op13_count_tokens": op13_count_tokens,
}

ORACLE = {
    "op2_mix_sources": OP2_SQL,
    "op3_find_pii": OP3_SQL,
    "op4_jaccard_components": OP4_SQL,
    "op5_rotate_perspectives": OP5_SQL,
    "op7_top_k": OP7_SQL,
    "op8_url_reputation": OP8_SQL,
    "op9_repeated_passages": OP9_SQL,
    "op12_missing_follow_ups": OP12_SQL,
}
