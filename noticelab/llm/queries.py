"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, langid, mixing, neardup, secret_scan, token_ids, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_decontaminate": decontaminate.query,
    "op3_language": langid.query,
    "op4_token_ids": token_ids.query,
    "op5_secrets": secret_scan.query,
    "op6_chat": chat.query,
    "op7_warc": warc.query,
    "op8_topk": topk.query,
    "op9_mixing": mixing.query,
    "op10_minhash_neardup": neardup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op8_topk": topk.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
}
