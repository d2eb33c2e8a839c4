"""Queries over the driver's tables, one for each operator, and the SQL of those that SQL expresses."""

from __future__ import annotations

from tephra.llm import op1_suffix_dedup, op2_line_frequency, op3_nearest_toxic, op4_seed_extend, op5_licence_digest, op6_lookup_sharding, op7_cross_entropy, op8_poisson_mix, op9_spaced_seeds, op10_jaccard_join

_MODULES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_frequency": op2_line_frequency,
    "op3_nearest_toxic": op3_nearest_toxic,
    "op4_seed_extend": op4_seed_extend,
    "op5_licence_digest": op5_licence_digest,
    "op6_lookup_sharding": op6_lookup_sharding,
    "op7_cross_entropy": op7_cross_entropy,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_jaccard_join": op10_jaccard_join,
}
QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLES = {name: m.ORACLE for name, m in _MODULES.items() if hasattr(m, "ORACLE")}
