"""The queries of this subpackage by name, with SQL where it can express them."""

from __future__ import annotations

from . import op1_chat, op2_language, op3_embeddings, op4_pii, op5_tokens, op6_warc, op7_decontamination, op8_mixing, op9_html, op10_minhash, op11_trie, op12_fingerprints, op13_alignment

QUERIES = {
    "op1_chat": op1_chat.op1_chat,
    "op2_language": op2_language.op2_language,
    "op3_embeddings": op3_embeddings.op3_embeddings,
    "op4_pii": op4_pii.op4_pii,
    "op5_tokens": op5_tokens.op5_tokens,
    "op6_warc": op6_warc.op6_warc,
    "op7_decontamination": op7_decontamination.op7_decontamination,
    "op8_mixing": op8_mixing.op8_mixing,
    "op9_html": op9_html.op9_html,
    "op10_minhash": op10_minhash.op10_minhash,
    "op11_trie": op11_trie.op11_trie,
    "op12_fingerprints": op12_fingerprints.op12_fingerprints,
    "op13_alignment": op13_alignment.op13_alignment,
}
SQL = {
    "op1_chat": op1_chat.SQL,
    "op3_embeddings": op3_embeddings.SQL,
    "op6_warc": op6_warc.SQL,
    "op8_mixing": op8_mixing.SQL,
    "op10_minhash": op10_minhash.SQL,
    "op11_trie": op11_trie.SQL,
}
