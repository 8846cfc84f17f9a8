"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from parapet.llm import (exact_dedup, katz, mixing, packing, preference, quality, ranked_search, repetition, simhash, skyband,
                         suffix_dedup, url_filter, vector_dedup)

QUERIES = {
    "op1_preference_format": preference.op1_preference_format,
    "op2_quality": quality.op2_quality,
    "op3_katz": katz.op3_katz,
    "op4_simhash": simhash.op4_simhash,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_product_quantisation": vector_dedup.op7_product_quantisation,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_skyband": skyband.op12_skyband,
    "op13_repetition": repetition.op13_repetition,
}

ORACLES = {
    "op1_preference_format": preference.OP1_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op12_skyband": skyband.OP12_SQL,
    "op13_repetition": repetition.OP13_SQL,
}
