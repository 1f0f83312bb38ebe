"""The queries of this subpackage and, where SQL can express one, its SQL."""

from turnlake.llm import chat_format, decontaminate, exact_dedup, language_id, minhash_dedup, mixing, ngram_join, ngram_lm, periodic_runs, quality_crf, secret_scan, sharding, vector_codes

QUERIES = {
    "op1_quality": quality_crf.op1_quality,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_language_id": language_id.op5_language_id,
    "op6_ngram_lm": ngram_lm.op6_ngram_lm,
    "op7_sharding": sharding.op7_sharding,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_mixing": mixing.op10_mixing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_minhash_dedup": minhash_dedup.op13_minhash_dedup,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op8_secret_scan": secret_scan.SQL,
    "op9_chat_format": chat_format.SQL,
    "op10_mixing": mixing.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_minhash_dedup": minhash_dedup.SQL,
}
