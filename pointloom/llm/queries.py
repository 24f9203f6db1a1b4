"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from . import chat, langid, minhash, mixing, packing, pii, tokens, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_chat_format": chat.op2_chat_format,
    "op3_lsh_forest": minhash.op3_lsh_forest,
    "op4_language_id": langid.op4_language_id,
    "op5_multi_index": vectors.op5_multi_index,
    "op6_token_shards": tokens.op6_token_shards,
    "op7_mixing": mixing.op7_mixing,
    "op8_flat_graph": vectors.op8_flat_graph,
    "op9_pii": pii.op9_pii,
    "op10_best_fit": packing.op10_best_fit,
}
ORACLES: dict[str, str] = {"op1_warc": warc.SQL, "op2_chat_format": chat.SQL, "op9_pii": pii.SQL, "op8_flat_graph": vectors.OP8_SQL}
