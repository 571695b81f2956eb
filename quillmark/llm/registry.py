"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from .exact_dedup import OP4_SQL, op4_exact_dedup
from .html_crf import op1_html_extraction
from .kneser_ney import op2_lm_scoring
from .line_dedup import op6_line_dedup
from .mixing import OP9_SQL, op9_mix_sources
from .packing import op5_packing
from .pii import op8_pii_surrogates
from .quality_rules import OP3_SQL, op3_quality_rules
from .simhash_vp import op7_simhash_near_dedup
from .warc import op10_warc

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_mix_sources": op9_mix_sources,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op9_mix_sources": OP9_SQL,
}
