"""The queries of this subpackage, by name, and the SQL that must return the same rows."""

from __future__ import annotations

from corpus_pipeline import run

from . import alignment, bpe, language, lexical, lm, mixing, neighbours, pages, pii, quality, simhash, syncmers, toxicity

QUERIES = {
    "op1_source_mixing": mixing.op1,
    "pipeline": run,
    "op4_pii_pseudonyms": pii.op4,
    "op5_syncmer_fingerprints": syncmers.op5,
    "op7_quality": quality.op7,
    "op6_language_id": language.op6,
    "op9_lm_scoring": lm.op9,
    "op8_bpe_encode_decode": bpe.op8,
    "op10_toxicity": toxicity.op10,
    "op2_nearest_neighbours": neighbours.op2,
    "op3_simhash_near_dedup": simhash.op3,
    "op11_tokenizer_alignment": alignment.op11,
    "op12_ranked_search": lexical.op12,
    "op13_page_text": pages.op13,
}
ORACLES: dict[str, str] = {
    "op1_source_mixing": mixing.ORACLE,
    "op12_ranked_search": lexical.ORACLE,
}
