"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from . import chat, minhash, mixing, packing, secrets, token_files, topk, toxicity, vectors, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_vectors": vectors.op2_vectors,
    "op3_token_files": token_files.op3_token_files,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_secrets": secrets.op5_secrets,
    "op6_minhash": minhash.op6_minhash,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_chat": chat.op9_chat,
    "op10_topk": topk.op10_topk,
}

ORACLE_SQL = {
    "op2_vectors": vectors.OP2_SQL,
    "op6_minhash": minhash.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_topk": topk.OP10_SQL,
}
