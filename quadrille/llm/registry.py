"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from quadrille.llm import bpe, chat, covertree, decontam, jaccard, langid, pii, ppm, substring, tokenfile


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii": pii.op1_pii,
        "op2_decontaminate": decontam.op2_decontaminate,
        "op3_token_files": tokenfile.op3_token_files,
        "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
        "op5_chat_snapshots": chat.op5_chat_snapshots,
        "op6_ppm_score": ppm.op6_ppm_score,
        "op7_language_id": langid.op7_language_id,
        "op8_exact_topk": covertree.op8_exact_topk,
        "op9_substring_repeats": substring.op9_substring_repeats,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict:
    return {"op4_ngram_jaccard": jaccard.SQL, "op5_chat_snapshots": chat.SQL, "op8_exact_topk": covertree.SQL, "op9_substring_repeats": substring.SQL}
