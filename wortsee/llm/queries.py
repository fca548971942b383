"""Queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from . import p1_canon, p2_terms, p3_scans, p4_sentences, p5_copies, p6_split, p7_tokens, p8_pack, p9_reading

QUERIES = {
    "p1_found": p1_canon.p1_found,
    "p1_values": p1_canon.p1_values,
    "p1_unmatched": p1_canon.p1_unmatched,
    "p2_found": p2_terms.p2_found,
    "p2_terms": p2_terms.p2_terms,
    "p3_found": p3_scans.p3_found,
    "p3_paragraphs": p3_scans.p3_paragraphs,
    "p4_found": p4_sentences.p4_found,
    "p5_found": p5_copies.p5_found,
    "p5_records": p5_copies.p5_records,
    "p6_found": p6_split.p6_found,
    "p6_pieces": p6_split.p6_pieces,
    "p6_checked": p6_split.p6_checked,
    "p7_ids": p7_tokens.p7_ids,
    "p8_containers": p8_pack.p8_containers,
    "p8_chars": p8_pack.p8_chars,
    "p9_found": p9_reading.p9_found,
    "p9_levels": p9_reading.p9_levels,
}

SQL = {**p2_terms.SQL, **p5_copies.SQL, **p6_split.SQL, **p8_pack.SQL}
