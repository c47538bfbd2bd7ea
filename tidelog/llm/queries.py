"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from tidelog.llm import exact_dedup, fingerprints, html_text, language_id, near_dedup, packing, piece_codec, repeats, sharding, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_sharding": sharding.op4_sharding,
    "op5_piece_codec": piece_codec.op5_piece_codec,
    "op6_packing": packing.op6_packing,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_html_text": html_text.op8_html_text,
    "op9_language_id": language_id.op9_language_id,
    "op10_repeats": repeats.op10_repeats,
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_url_filter": url_filter.SQL,
}
