"""Registered queries of this subpackage: one an operator, over its whole table."""

from __future__ import annotations

from trefoil.llm.anchors import op9_block_anchors
from trefoil.llm.bpe import op6_byte_bpe
from trefoil.llm.cascade import op8_rule_cascade
from trefoil.llm.imatch import op7_imatch
from trefoil.llm.importance import op12_importance_resampling
from trefoil.llm.mixing import op1_mix_sources
from trefoil.llm.periodic import op11_periodic_runs
from trefoil.llm.quality import op4_pu_quality
from trefoil.llm.ring import op5_ring_shards
from trefoil.llm.secrets import op3_secret_scan
from trefoil.llm.simhash import op2_simhash_near_dedup
from trefoil.llm.suffix import op10_suffix_dedup
from trefoil.llm.urls import op13_url_filter

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_pu_quality": op4_pu_quality,
    "op5_ring_shards": op5_ring_shards,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_imatch": op7_imatch,
    "op8_rule_cascade": op8_rule_cascade,
    "op9_block_anchors": op9_block_anchors,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_url_filter": op13_url_filter,
}
