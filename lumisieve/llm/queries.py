"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import conversation_repair, fill_in_middle, huffman, language_id, line_dedup, matroska, mixing, near_vectors, ngram_join, packing, token_counts, toxicity, transcripts

QUERIES = {
    "op1_token_output": huffman.op1_token_output,
    "op2_mixing": mixing.op2_mixing,
    "op3_near_vectors": near_vectors.op3_near_vectors,
    "op4_packing": packing.op4_packing,
    "op5_media": matroska.op5_media,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_transcripts": transcripts.op7_transcripts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_language_id": language_id.op12_language_id,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op3_near_vectors": near_vectors.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
