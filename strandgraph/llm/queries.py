"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, fingerprint, html, langid, lexical, mixing, neardup, packing, quality, spelling, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_document_fingerprints": fingerprint.op1,
        "op2_source_mixing": mixing.op2,
        "op3_quality": quality.op3,
        "op4_chat_formatting": chat.op4,
        "op5_url_filters": urlfilter.op5,
        "op6_html_extraction": html.op6,
        "op7_minhash_near_dedup": neardup.op7,
        "op8_language_id": langid.op8,
        "op9_benchmark_decontamination": decontam.op9,
        "op10_toxicity": toxicity.op10,
        "op11_spelling_variants": spelling.op11,
        "op12_lexical_search": lexical.op12,
        "op13_packing": packing.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": mixing.OP2_SQL,
        "op5_url_filters": urlfilter.OP5_SQL,
        "op9_benchmark_decontamination": decontam.OP9_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
        "op12_lexical_search": lexical.OP12_SQL,
    }
