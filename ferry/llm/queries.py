"""The registered queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from ferry.llm import bitslice, langid, lm, merkle, mixing, neardup, phrases, pieces, pii, secret_scan, toxicity, vptree, warc


def registry() -> dict:
    return {
        "op1_pii": (pii.op1, None),
        "op2_secrets": (secret_scan.op2, None),
        "op5_toxicity": (toxicity.op5, None),
        "op4_langid": (langid.op4, None),
        "op3_sentencepiece": (pieces.op3, None),
        "op6_vptree": (vptree.op6, vptree.OP6_SQL),
        "op7_neardup": (neardup.op7, neardup.OP7_SQL),
        "op8_bitslice": (bitslice.op8, bitslice.OP8_SQL),
        "op9_mixing": (mixing.op9, mixing.OP9_SQL),
        "op10_warc": (warc.op10, warc.OP10_SQL),
        "op11_merkle": (merkle.op11, merkle.OP11_SQL),
        "op12_lm": (lm.op12, None),
        "op13_phrases": (phrases.op13, phrases.OP13_SQL),
    }
