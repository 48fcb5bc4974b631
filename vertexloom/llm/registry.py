"""Queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from vertexloom.llm.byte_bpe import op4_byte_bpe
from vertexloom.llm.language import op1_language_id
from vertexloom.llm.packing import op5_best_fit_packing
from vertexloom.llm.pii import op9_pii
from vertexloom.llm.quality_model import op6_quality_classifier
from vertexloom.llm.quality_rules import SQL as RULES_SQL
from vertexloom.llm.quality_rules import op8_quality_rules
from vertexloom.llm.simhash import op2_simhash
from vertexloom.llm.token_count import op3_token_counts
from vertexloom.llm.topk import SQL as TOP_K_SQL
from vertexloom.llm.topk import op10_exact_top_k
from vertexloom.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_token_counts, op4_byte_bpe, op5_best_fit_packing, op6_quality_classifier, op7_toxicity, op8_quality_rules, op9_pii, op10_exact_top_k)}
SQL = {"op8_quality_rules": RULES_SQL, "op10_exact_top_k": TOP_K_SQL}
