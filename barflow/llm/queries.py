"""Registered queries of this subpackage and their SQL."""

from barflow.llm import (
    additive, language_model, merkle, mixing, neighbours, phrases, quality, sentence_pieces, simhash, site_lines, token_counts,
    toxicity, warc,
)

QUERIES = {
    "op1_sentence_pieces": sentence_pieces.op1_sentence_pieces,
    "op2_language_model": language_model.op2_language_model,
    "op3_quality": quality.op3_quality,
    "op4_warc": warc.op4_warc,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_site_lines": site_lines.op10_site_lines,
    "op11_quality_model": additive.op11_quality_model,
    "op12_phrases": phrases.op12_phrases,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op4_warc": warc.SQL,
    "op3_quality": quality.SQL,
    "op6_mix_sources": mixing.SQL,
    "op10_site_lines": site_lines.SQL,
    "op12_phrases": phrases.SQL,
    "op13_merkle": merkle.SQL,
}
