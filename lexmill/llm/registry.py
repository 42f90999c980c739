"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import chat, decontaminate, fim, language, licenses, matrices, packing, pii, ranked, simhash, topk, toxicity, warc

QUERIES = {
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_warc": warc.op5_warc,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_token_id_output": matrices.op3_token_id_output,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op10_pii": pii.op10_pii,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_language_id": language.op13_language_id,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.SQL,
    "op1_exact_top_k": topk.SQL,
    "op5_warc": warc.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_fill_in_middle": fim.SQL,
}
