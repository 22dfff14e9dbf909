"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

QUERIES = {
    "op1_pack": op1.query,
    "op2_lm_scores": op2.query,
    "op3_unit_dedup": op3.query,
    "op3_sentences": op3.sentences,
    "op3_passages": op3.passages,
    "op4_language": op4.query,
    "op5_fingerprints": op5.query,
    "op6_line_dedup": op6.query,
    "op7_near_copies": op7.query,
    "op8_secrets": op8.query,
    "op9_token_counts": op9.query,
    "op10_decontaminate": op10.query,
    "op10_proximity": op10.near,
    "op11_turn_reassembly": op11.query,
    "op12_main_text": op12.query,
    "op13_vector_codes": op13.query,
}
ORACLES = {"op3_unit_dedup": op3.SQL, "op3_sentences": op3.SENTENCES_SQL, "op3_passages": op3.PASSAGES_SQL, "op5_fingerprints": op5.SQL, "op6_line_dedup": op6.SQL, "op7_near_copies": op7.SQL, "op10_decontaminate": op10.SQL, "op11_turn_reassembly": op11.SQL, "op13_vector_codes": op13.SQL}
