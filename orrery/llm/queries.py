"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import backoff_lm, html_wrapper, line_crf, minhash, mixing, order_minhash, packing, quality_rules, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_line_crf": line_crf.op1_line_crf,
        "op2_packing": packing.op2_packing,
        "op3_minhash": minhash.op3_minhash,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op5_html_wrapper": html_wrapper.op5_html_wrapper,
        "op7_backoff_lm": backoff_lm.op7_backoff_lm,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_order_minhash": order_minhash.op9_order_minhash,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL}
