"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from missive.llm import bwt_dedup, chat, embedding_dedup, forced_bpe, line_dedup, minhash, mixing, packing, simhash, spelling, token_store, toxicity, vector_codes

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_store": token_store.op5_token_store,
    "op6_chat": chat.op6_chat,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_minhash": minhash.op9_minhash,
    "op10_bwt_dedup": bwt_dedup.op10_bwt_dedup,
    "op11_spelling_groups": spelling.op11_spelling_groups,
    "op12_forced_bpe": forced_bpe.op12_forced_bpe,
    "op13_vector_codes": vector_codes.op13_vector_codes,
    "minhash_near_duplicates": minhash.minhash_near_duplicates,
}
ORACLE_SQL = {"op3_line_dedup": line_dedup.OP3_SQL, "op6_chat": chat.OP6_SQL, "op11_spelling_groups": spelling.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
