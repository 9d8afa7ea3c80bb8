"""The queries of the training-data operators and their SQL, as __spark_entry__ adds them."""

from __future__ import annotations

from folioflow.llm import bpe, chat, embedding, lines, maxent, mixing, near, quality, substrings, toxicity

QUERIES = {
    "op1_chat_prefix_targets": chat.op1_chat_prefix_targets,
    "op2_pivotal_mix": mixing.op2_pivotal_mix,
    "op3_host_quality": quality.op3_host_quality,
    "op4_toxicity_chain": toxicity.op4_toxicity_chain,
    "op5_line_spread": lines.op5_line_spread,
    "op6_suffix_array_dedup": substrings.op6_suffix_array_dedup,
    "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
    "op8_bagminhash_near_dup": near.op8_bagminhash_near_dup,
    "op9_hyperplane_near_dup": embedding.op9_hyperplane_near_dup,
    "op10_maxent_scores": maxent.op10_maxent_scores,
}

ORACLE_SQL = {
    "op1_chat_prefix_targets": chat.OP1_SQL,
    "op3_host_quality": quality.OP3_SQL,
    "op5_line_spread": lines.OP5_SQL,
    "op9_hyperplane_near_dup": embedding.OP9_SQL,
}
