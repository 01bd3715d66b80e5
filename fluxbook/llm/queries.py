"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fluxbook.llm.conversations import OP11_SQL, op11_repair_conversations
from fluxbook.llm.divergence import OP12_SQL, op12_source_divergence
from fluxbook.llm.language import op6_language_id
from fluxbook.llm.mixing import OP1_SQL, op1_mix_sources
from fluxbook.llm.quality_rules import op7_quality_rules
from fluxbook.llm.resampling import op9_importance_resampling
from fluxbook.llm.secrets import OP3_SQL, op3_secret_scan
from fluxbook.llm.shingle_join import op2_shingle_join
from fluxbook.llm.suffix_tree import op8_lm_scores
from fluxbook.llm.templates import op5_template_decontamination
from fluxbook.llm.token_counts import op4_token_counts
from fluxbook.llm.toxicity import op13_toxicity
from fluxbook.llm.urls import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shingle_join": op2_shingle_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scores": op8_lm_scores,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_url_filter": op10_url_filter,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_source_divergence": op12_source_divergence,
    "op13_toxicity": op13_toxicity,
}
ORACLES = {
    "op1_mix_sources": OP1_SQL,
    "op3_secret_scan": OP3_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_repair_conversations": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
