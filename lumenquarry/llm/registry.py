"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import jaccard, kd_shards, lines, media, mixing, packing, quality, secrets, token_store, web_archive

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_media_sequences": media.op2_media_sequences,
    "op3_pack_windows": packing.op3_pack_windows,
    "op4_pfair_mix": mixing.op4_pfair_mix,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_arc_to_warc": web_archive.op6_arc_to_warc,
    "op7_quality_divergence": quality.op7_quality_divergence,
    "op8_token_store": token_store.op8_token_store,
    "op9_fuzzy_lines": lines.op9_fuzzy_lines,
    "op10_kd_shards": kd_shards.op10_kd_shards,
}
ORACLE_SQL = {
    "op1_ngram_jaccard": jaccard.OP1_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op6_arc_to_warc": web_archive.OP6_SQL,
    "op7_quality_divergence": quality.OP7_SQL,
}
