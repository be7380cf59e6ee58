"""The corpus operators' queries over the input tables, and the SQL that each is compared with where SQL can say it."""

from __future__ import annotations

from . import audit, bitslice, bpe, centroids, decontam, extract, licenses, media, ngram, pii, quality, secrets, simhash

QUERIES = {
    "op1_html_extraction": extract.op1_html_extraction,
    "op2_lm_scores": ngram.op2_lm_scores,
    "op3_quality_gam": quality.op3_quality_gam,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_media_tiles": media.op5_media_tiles,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_pii_pseudonyms": pii.op9_pii_pseudonyms,
    "op10_simhash": simhash.op10_simhash,
    "op11_centroids": centroids.op11_centroids,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_bitslice_topk": bitslice.op13_bitslice_topk,
}
ORACLE: dict[str, str] = {
    "op2_lm_scores": ngram.SQL,
    "op4_license_scan": licenses.SQL,
    "op7_secret_scan": secrets.SQL,
    "op8_decontamination": decontam.SQL,
    "op11_centroids": centroids.SQL,
    "op12_filter_audit": audit.SQL,
    "op13_bitslice_topk": bitslice.SQL,
}
