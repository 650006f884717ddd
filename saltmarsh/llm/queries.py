"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from saltmarsh.llm import exact_dedup, lexical_search, lm_scoring, mixing, odd_sketch, packing, pii, quality, sharding, simhash, spelling, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_delta_token_counts": token_counts.op1_delta_token_counts,
        "op2_bounded_space_pack": packing.op2_bounded_space_pack,
        "op3_ordinal_toxicity": toxicity.op3_ordinal_toxicity,
        "op4_cross_entropy_difference": lm_scoring.op4_cross_entropy_difference,
        "op5_keyed_surrogates": pii.op5_keyed_surrogates,
        "op6_gray_simhash": simhash.op6_gray_simhash,
        "op7_content_sort_dedup": exact_dedup.op7_content_sort_dedup,
        "op8_mcd_quality": quality.op8_mcd_quality,
        "op9_hash_tree_shards": sharding.op9_hash_tree_shards,
        "op10_block_mix": mixing.op10_block_mix,
        "op11_reversed_search": lexical_search.op11_reversed_search,
        "op12_spelling_composition": spelling.op12_spelling_composition,
        "op13_odd_sketch_minhash": odd_sketch.op13_odd_sketch_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_content_sort_dedup": exact_dedup.SQL7,
        "op11_reversed_search": lexical_search.SQL11,
        "op12_spelling_composition": spelling.SQL12,
        "op13_odd_sketch_minhash": odd_sketch.SQL13,
    }
