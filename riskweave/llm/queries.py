"""The registered queries of this package: name -> builder, and SQL where it can express them."""

from __future__ import annotations

from riskweave.llm import chat, fingerprints, jaccard, mixing, negatives, pieces, quality, secrets, spelling, toxicity, urls, vectors, warc

QUERIES = {
    "op2_quality": quality.op2_quality,
    "op4_vectors": vectors.op4_vectors,
    "op1_warc": warc.op1_warc,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op5_url_filters": urls.op5_url_filters,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_pieces": pieces.op9_pieces,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling": spelling.op11_spelling,
    "op12_negatives": negatives.op12_negatives,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES = {
    "op4_vectors": vectors.OP4_SQL,
    "op1_warc": warc.OP1_SQL,
    "op5_url_filters": urls.OP5_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_negatives": negatives.OP12_SQL,
    "op13_secrets": secrets.OP13_SQL,
}
