"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, html, importance, jaccard, kmeans, linededup, media, mixing, packing, pii, quality, tokencount

_QUERIES = {
    "op1_mixing": (mixing.op1_mixing, mixing.OP1_SQL),
    "op2_chat": (chat.op2_chat, chat.OP2_SQL),
    "op3_line_dedup": (linededup.op3_line_dedup, linededup.OP3_SQL),
    "op4_bpe": (bpe.op4_bpe, None),
    "op5_html": (html.op5_html, None),
    "op6_pii": (pii.op6_pii, None),
    "op7_token_counts": (tokencount.op7_token_counts, None),
    "op8_jaccard": (jaccard.op8_jaccard, None),
    "op9_quality": (quality.op9_quality, quality.OP9_SQL),
    "op10_media": (media.op10_media, None),
    "op11_importance": (importance.op11_importance, None),
    "op12_kmeans": (kmeans.op12_kmeans, kmeans.OP12_SQL),
    "op13_packing": (packing.op13_packing, None),
}


def queries():
    return {k: q for k, (q, _) in _QUERIES.items()}


def oracle_sql():
    return {k: s for k, (_, s) in _QUERIES.items() if s}
