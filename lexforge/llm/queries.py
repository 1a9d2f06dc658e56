"""Queries and SQL of this subpackage, for registration."""

from __future__ import annotations

from . import (
    decontaminate,
    html_extract,
    jaccard_join,
    lz_fingerprint,
    packing,
    quality_cnn,
    secret_scan,
    transcripts,
    url_filter,
    warc_writer,
)

QUERIES = {
    "op1_lz_fingerprint": lz_fingerprint.query,
    "op2_decontaminate": decontaminate.query,
    "op3_quality_cnn": quality_cnn.query,
    "op4_warc_writer": warc_writer.query,
    "op5_html_extract": html_extract.query,
    "op6_url_filter": url_filter.query,
    "op7_packing": packing.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_transcripts": transcripts.query,
    "op10_secret_scan": secret_scan.query,
}

SQL: dict[str, str] = {
    "op7_packing": packing.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
}
