"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, chat_format, exact_dedup, line_dedup, merkle, mixing, ngram_join, packing, pii, quality_rules, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op4_chat_format": chat_format.op4_chat_format,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_cost_packing": packing.op3_cost_packing,
    "op5_site_spread_lines": line_dedup.op5_site_spread_lines,
    "op6_skip_chain_pii": pii.op6_skip_chain_pii,
    "op7_warc_index": warc.op7_warc_index,
    "op8_radix_exact_dedup": exact_dedup.op8_radix_exact_dedup,
    "op9_suffix_levels": suffix_dedup.op9_suffix_levels,
    "op10_quality_ledger": quality_rules.op10_quality_ledger,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLE = {
    "op5_site_spread_lines": line_dedup.OP5_SQL,
    "op7_warc_index": warc.OP7_SQL,
    "op1_source_mix": mixing.OP1_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op8_radix_exact_dedup": exact_dedup.OP8_SQL,
    "op10_quality_ledger": quality_rules.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
}
