"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from tessella.llm import bpe, chat, divergence, exact_dedup, langid, minhash, packing, pii, quality, warc_zip

QUERIES = {
    "op1_divergence": divergence.op1_divergence,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_pii_anchors": pii.op4_pii_anchors,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_warc_zip": warc_zip.op6_warc_zip,
    "op7_quality_nbsvm": quality.op7_quality_nbsvm,
    "op8_minhash_icws": minhash.op8_minhash_icws,
    "op9_word_bpe": bpe.op9_word_bpe,
    "op10_chat_format": chat.op10_chat_format,
}

ORACLE_SQL = {
    "op1_divergence": divergence.ORACLE_OP1,
    "op2_exact_dedup": exact_dedup.ORACLE_OP2,
    "op6_warc_zip": warc_zip.ORACLE_OP6,
    "op10_chat_format": chat.ORACLE_OP10,
}
