"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from sieveline.llm import bpe, exact_dedup, hmm_lm, language_id, lexical, mixing, packing, simhash, toxicity, url_filter, vector_dedup, warc, whitening


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_language_id": language_id.op2_language_id,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_vector_near_dedup": vector_dedup.op4_vector_near_dedup,
        "op5_hmm_lm": hmm_lm.op5_hmm_lm,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_simhash": simhash.op9_simhash,
        "pipeline": corpus_pipeline.run,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_whitening": whitening.op11_whitening,
        "op12_wand": lexical.op12_wand,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op7_url_filter": url_filter.OP7_SQL,
        "op10_mix_sources": mixing.OP10_SQL,
        "op12_wand": lexical.OP12_SQL,
    }
