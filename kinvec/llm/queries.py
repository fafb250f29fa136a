"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontamination import OP6_SQL, op6_decontamination
from .near_dedup import op2_near_dedup
from .packing import op5_packing
from .pii import op8_pii
from .quality import op10_quality_rules
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .suffix_dedup import OP1_SQL, op1_suffix_dedup
from .token_counts import op9_token_counts
from .toxicity import op3_toxicity
from .url_filters import OP7_SQL, op7_url_filters

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_url_filters": op7_url_filters,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_url_filters": OP7_SQL,
}
