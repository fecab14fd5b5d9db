"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import jaccard, licenses, linequality, mixing, neighbours, packing, ranked, recipes, secrets, sharding, spelling, substrings, toxicity

QUERIES = {
    "op1_adaptive_prefix": jaccard.op1_adaptive_prefix,
    "op2_multi_index": neighbours.op2_multi_index,
    "op3_kneser_ney": toxicity.op3_kneser_ney,
    "op4_poisson_mix": mixing.op4_poisson_mix,
    "op5_diagonal_voting": licenses.op5_diagonal_voting,
    "op6_hash_tree": sharding.op6_hash_tree,
    "op7_super_kmers": substrings.op7_super_kmers,
    "op8_line_frequency": linequality.op8_line_frequency,
    "op9_crf": secrets.op9_crf,
    "op10_vector_best_fit": packing.op10_vector_best_fit,
    "op11_ball_tree": ranked.op11_ball_tree,
    "op12_chunk_recipes": recipes.op12_chunk_recipes,
    "op13_composition": spelling.op13_composition,
}
ORACLES = {"op4_poisson_mix": mixing.OP4_SQL, "op6_hash_tree": sharding.OP6_SQL, "op7_super_kmers": substrings.OP7_SQL, "op8_line_frequency": linequality.OP8_SQL, "op11_ball_tree": ranked.OP11_SQL, "op12_chunk_recipes": recipes.OP12_SQL}
