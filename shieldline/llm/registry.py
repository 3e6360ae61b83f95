"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from shieldline.llm import brown, chat, decontaminate, fingerprints, jaccard, language, minhash, packing, pii, ranked, repeats, toxicity, whitening

QUERIES = {
    "op1_tool_calls": chat.op1_tool_calls,
    "op2_brown": brown.op2_brown,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_fingerprint": fingerprints.op5_fingerprint,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_language": language.op9_language,
    "op10_repeats": repeats.op10_repeats,
    "op11_minhash": minhash.op11_minhash,
    "op12_whitening": whitening.op12_whitening,
    "op13_ranked": ranked.op13_ranked,
}

SQL = {
    "op4_jaccard": jaccard.OP4_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op11_minhash": minhash.OP11_SQL,
    "op13_ranked": ranked.OP13_SQL,
}
