"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, filter_audit, jaccard_join, knn_quality, license_scan, line_frequency, merkle_manifest, soft_mixing, syncmers, token_frames, toxicity, url_filter, warc_zip


def queries():
    return {
        "op1_line_frequency": line_frequency.op1_line_frequency,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_syncmers": syncmers.op4_syncmers,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_warc_zip": warc_zip.op6_warc_zip,
        "op7_soft_mixing": soft_mixing.op7_soft_mixing,
        "op8_token_frames": token_frames.op8_token_frames,
        "op9_knn_quality": knn_quality.op9_knn_quality,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql():
    return {"op1_line_frequency": line_frequency.SQL, "op3_jaccard_join": jaccard_join.SQL, "op5_license_scan": license_scan.sql(), "op6_warc_zip": warc_zip.SQL, "op11_merkle_manifest": merkle_manifest.SQL, "op12_filter_audit": filter_audit.SQL}
