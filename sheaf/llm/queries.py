"""The operators' registered queries."""

from __future__ import annotations

from . import clusters, decontaminate, fingerprint, language, near, phrases, pieces, quality, sharding, suffixes, tokens, urls, windows

QUERIES = {
    "op1_token_counts": tokens.query,
    "op2_near_duplicates": near.query,
    "op3_feistel_sharding": sharding.query,
    "op4_url_filter": urls.query,
    "op5_language": language.query,
    "op6_decontamination": decontaminate.query,
    "op7_fingerprints": fingerprint.query,
    "op8_suffix_dedup": suffixes.query,
    "op9_sentencepiece": pieces.query,
    "op10_window_dedup": windows.query,
    "op11_quality_rules": quality.query,
    "op12_centroids": clusters.query,
    "op13_collocations": phrases.query,
}

ORACLES: dict[str, str] = {
    "op6_decontamination": decontaminate.ORACLE,
    "op10_window_dedup": windows.ORACLE,
    "op12_centroids": clusters.ORACLE,
    "op13_collocations": phrases.ORACLE,
}
