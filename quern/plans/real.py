"""The rules for queries over real texts: turns of conversations and whole documents in place of the phrases, with the same oracles."""

from __future__ import annotations

from quern.plans.catalog import ORACLES, QUERIES, register
from quern.plans.phrases import ASKED, REAL, on_real_rows

RULES = (
    "sco_query_classification", "sco_tier_routing_cost", "sco_output_type", "evi_query_expansion", "qry_decomposition", "qry_sub_question_estimate", "qry_complexity", "qry_triggers",
    "qry_ensemble", "qry_escalation", "qry_comparison_entities", "qry_structured_plan", "clm_query_specificity", "aug_code_query", "dec_rewritten_queries", "dec_backtracking",
    "src_expanded_queries", "svc_prompts", "svc_answers",
)
for _name in RULES:
    register(f"{_name}_texts", on_real_rows(QUERIES[_name]), ORACLES[_name].replace(ASKED, REAL))
