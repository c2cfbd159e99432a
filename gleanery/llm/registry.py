"""Queries and SQL of this folder."""

from . import bpe, decontaminate, exact_dedup, lm, near_dedup, personal, quality, repeats, secrets, token_counts

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_remove_repeats": repeats.op5_remove_repeats,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_personal_data": personal.op7_personal_data,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_lm_scores": lm.op9_lm_scores,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_near_dedup": near_dedup.SQL,
}
