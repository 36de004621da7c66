"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embedding_dedup, exact_topk, near_dedup, pii, quality, secrets, warc
from .bpe_codec import op10_bpe
from .packing import op6_packing
from .token_counts import op3_token_counts

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality": quality.op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_secrets": secrets.op4_secrets,
    "op5_exact_topk": exact_topk.op5_exact_topk,
    "op6_packing": op6_packing,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_pii": pii.op9_pii,
    "op10_bpe": op10_bpe,
}
ORACLES = {"op1_warc": warc.ORACLE, "op5_exact_topk": exact_topk.ORACLE, "op7_embedding_dedup": embedding_dedup.ORACLE, "op8_near_dedup": near_dedup.ORACLE}
