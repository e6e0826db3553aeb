"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from . import jaccard, language, licenses, mixing, packing, quality, sharding, simhash, topk, warc

QUERIES = {
    "op1_license_blocks": licenses.op1_license_blocks,
    "op2_subword_quality": quality.op2_subword_quality,
    "op3_pfair_mix": mixing.op3_pfair_mix,
    "op4_length_buckets": packing.op4_length_buckets,
    "op5_simhash": simhash.op5_simhash,
    "op6_warc_index": warc.op6_warc_index,
    "op7_adaptive_prefix": jaccard.op7_adaptive_prefix,
    "op8_virtual_slots": sharding.op8_virtual_slots,
    "op9_dual_cover_tree": topk.op9_dual_cover_tree,
    "op10_output_codes": language.op10_output_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_blocks": licenses.oracle(),
    "op6_warc_index": warc.ORACLE,
    "op7_adaptive_prefix": jaccard.ORACLE,
    "op9_dual_cover_tree": topk.ORACLE,
}
