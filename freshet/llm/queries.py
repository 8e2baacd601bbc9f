"""The corpus operators as queries over the tables of a folder, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fingerprint, html_text, jaccard_join, language_id, line_dedup, mixing, quality, suffix_dedup, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1,
    "op2_language_id": language_id.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_html_text": html_text.op4,
    "op5_quality_classifier": quality.op5,
    "op6_jaccard_join": jaccard_join.op6,
    "op7_warc": warc.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_mixing": mixing.op9,
    "op10_fingerprints": fingerprint.op10,
}

ORACLE_SQL = {"op7_warc": warc.SQL, "op8_line_dedup": line_dedup.SQL, "op9_mixing": mixing.SQL}
