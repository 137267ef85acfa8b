"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import decontam, html_layout, maxent, minhash, oracles, orc_tokens, packing, pii, superkmer, tiff, toxicity

QUERIES = {
    "op1_skip_chain_crf": pii.op1_skip_chain_crf,
    "op2_noisy_channel_toxicity": toxicity.op2_noisy_channel_toxicity,
    "op3_sum_of_squares_packing": packing.op3_sum_of_squares_packing,
    "op4_tiff_pages": tiff.op4_tiff_pages,
    "op5_bbit_minhash": minhash.op5_bbit_minhash,
    "op6_layout_aware_rendering": html_layout.op6_layout_aware_rendering,
    "op7_hashed_maxent": maxent.op7_hashed_maxent,
    "op8_super_kmer_dedup": superkmer.op8_super_kmer_dedup,
    "op9_orc_token_ids": orc_tokens.op9_orc_token_ids,
    "op10_winnowing_decontamination": decontam.op10_winnowing_decontamination,
}

ORACLES: dict[str, str] = {
    "op5_bbit_minhash": oracles.OP5,
    "op8_super_kmer_dedup": oracles.OP8,
    "op10_winnowing_decontamination": oracles.OP10,
}
