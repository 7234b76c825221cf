"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chats, divergence, exact_dedup, licenses, lm_scores, mixing, ngram_join, pii, quality, resampling, simhash, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_licenses": licenses.op2_licenses,
    "op3_chats": chats.op3_chats,
    "op4_quality": quality.op4_quality,
    "op5_lm_scores": lm_scores.op5_lm_scores,
    "op6_warc": warc.op6_warc,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_bpe": bpe.op8_bpe,
    "op9_pii": pii.op9_pii,
    "op10_mixing": mixing.op10_mixing,
    "op11_divergence": divergence.op11_divergence,
    "op12_simhash": simhash.op12_simhash,
    "op13_resampling": resampling.op13_resampling,
}

SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_licenses": licenses.op2_sql(),
    "op4_quality": quality.OP4_SQL,
    "op5_lm_scores": lm_scores.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op13_resampling": resampling.OP13_SQL,
}
