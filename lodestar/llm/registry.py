"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import bytespan, conversations, decontaminate, exact, lm, merkle, minhash, mixing, pii, quality, simhash, substring, tokens

QUERIES = {
    "op1_lm": lm.op1_lm,
    "op2_substring": substring.op2_substring,
    "op3_mix": mixing.op3_mix,
    "op4_tokens": tokens.op4_tokens,
    "op5_bytespan": bytespan.op5_bytespan,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": quality.op8_quality,
    "op9_pii": pii.op9_pii,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_minhash": minhash.op11_minhash,
    "op12_conversations": conversations.op12_conversations,
    "op13_merkle": merkle.op13_merkle,
}

SQL = {"op5_bytespan": bytespan.SQL, "op6_decontaminate": decontaminate.SQL, "op10_exact_dedup": exact.SQL, "op11_minhash": minhash.SQL, "op12_conversations": conversations.SQL, "op13_merkle": merkle.SQL}
