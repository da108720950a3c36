"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import mixing, neardup, pages, pieces, secrets, suffixes, syncmers, token_orc, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_orc": token_orc.op3_token_orc,
    "op4_pieces": pieces.op4_pieces,
    "op5_minhash": neardup.op5_minhash,
    "op6_secrets": secrets.op6_secrets,
    "op7_fingerprints": syncmers.op7_fingerprints,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_pages": pages.op9_pages,
    "op10_topk": topk.op10_topk,
}
ORACLE_SQL = {"op2_mixing": mixing.OP2_SQL, "op5_minhash": neardup.OP5_SQL, "op10_topk": topk.OP10_SQL}
