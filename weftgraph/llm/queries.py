"""The thin ``opN_`` queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from weftgraph.llm import decontamination, html_text, language_id, license_scan, packing, quality, secret_scan, simhash, substring_dedup, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_packing": packing.op2_packing,
    "op3_language_id": language_id.op3_language_id,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_license_scan": license_scan.op10_license_scan,
}

ORACLE_SQL = {
    "op1_url_filters": url_filters.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_secret_scan": secret_scan.oracle(),
    "op10_license_scan": license_scan.oracle(),
}
