"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import ann, binary, bpe, lines, minhash, packing, pii, quality, substring, webp


def queries():
    return {
        "op1_pii": pii.op1,
        "op2_minhash": minhash.op2,
        "op3_ann": ann.op3,
        "op4_quality": quality.op4,
        "op5_bpe": bpe.op5,
        "op6_substring": substring.op6,
        "op7_token_ids": binary.op7,
        "op8_packing": packing.op8,
        "op9_lines": lines.op9,
        "op10_webp": webp.op10,
    }


def oracle_sql():
    return {"op9_lines": lines.ORACLE}
