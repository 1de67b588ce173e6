"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from caseweave.llm import (
    collisions, line_quality, mixing, ngram_join, packing, page_text, sharding, subword, suffixes,
    term_search, token_files, warc, whitening,
)

QUERIES = {
    "op1_collision_counting": collisions.op1_collision_counting,
    "op2_subword_quality": subword.op2_subword_quality,
    "op3_line_frequency": line_quality.op3_line_frequency,
    "op4_suffix_buckets": suffixes.op4_suffix_buckets,
    "op5_karmarkar_karp": sharding.op5_karmarkar_karp,
    "op6_multinomial_mix": mixing.op6_multinomial_mix,
    "op7_ngram_product": ngram_join.op7_ngram_product,
    "op8_seekable_ids": token_files.op8_seekable_ids,
    "op9_salvage": warc.op9_salvage,
    "op10_min_slack": packing.op10_min_slack,
    "op11_dom_crf": page_text.op11_dom_crf,
    "op12_term_owners": term_search.op12_term_owners,
    "op13_shifted_choleskyqr": whitening.op13_shifted_choleskyqr,
}

ORACLES = {
    "op3_line_frequency": line_quality.OP3_SQL,
    "op12_term_owners": term_search.OP12_SQL,
}
