"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from .chat import OP11_SQL, op11_chat_formatting
from .decontaminate import op1_decontamination
from .divergence import OP12_SQL, op12_source_divergence
from .langid import op8_language_id
from .mixing import OP7_SQL, op7_mixing
from .near import op10_minhash_near_dedup
from .pii import op9_pii
from .quality import op2_quality_rules
from .repair import OP13_SQL, op13_conversation_repair
from .rollups import op5_token_counts
from .suffix import op6_suffix_dedup
from .tokens import op4_token_output
from .urls import OP3_SQL, op3_url_filters

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op4_token_output": op4_token_output,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op3_url_filters": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op11_chat_formatting": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
