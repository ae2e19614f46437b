"""Queries of this subpackage and their SQL, by name."""

from heliograph.llm import chat, decontaminate, erasure, knn, language, licenses, mixing, pieces, repeats, runs, secrets, sharding, simhash

QUERIES = {
    "op1_language": language.op1_language,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_sharding": sharding.op4_sharding,
    "op5_secrets": secrets.op5_secrets,
    "op6_chat": chat.op6_chat,
    "op7_licenses": licenses.op7_licenses,
    "op8_topk": knn.op8_topk,
    "op9_mixing": mixing.op9_mixing,
    "op10_repeats": repeats.op10_repeats,
    "op11_erasure": erasure.op11_erasure,
    "op12_pieces": pieces.op12_pieces,
    "op13_runs": runs.op13_runs,
}

ORACLE_SQL = {
    "op6_chat": chat.OP6_SQL,
    "op8_topk": knn.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
