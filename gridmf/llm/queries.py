"""Registered queries of the text operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from gridmf.llm.align import op12_tokenizer_alignment
from gridmf.llm.chat import OP11_SQL, op11_chat_formatting
from gridmf.llm.decontaminate import op5_decontamination
from gridmf.llm.fingerprint import op8_fingerprints
from gridmf.llm.langid import op6_language_id
from gridmf.llm.license import op7_license_scan
from gridmf.llm.lm import op2_suffix_tree_scores
from gridmf.llm.neardup import op1_near_dedup
from gridmf.llm.packing import op9_packing
from gridmf.llm.runs import op13_periodic_runs
from gridmf.llm.substring import op4_substring_dedup
from gridmf.llm.tokenfile import op10_token_file
from gridmf.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_suffix_tree_scores": op2_suffix_tree_scores,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_token_file": op10_token_file,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {"op11_chat_formatting": OP11_SQL}
