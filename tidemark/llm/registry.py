"""Queries of this folder and their SQL, for ``__spark_entry__``."""

from . import chat, decontaminate, licenses, lm, near, packing, quality, rules, tokens, toxicity


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            quality.op1_quality_classifier,
            decontaminate.op2_decontamination,
            packing.op3_packing,
            near.op4_jaccard_join,
            toxicity.op5_toxicity,
            chat.op6_chat_format,
            rules.op7_quality_rules,
            tokens.op8_token_counts,
            licenses.op9_license_scan,
            lm.op10_lm_score,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_license_scan": licenses.oracle_sql()}
