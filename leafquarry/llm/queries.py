"""Queries of the subpackage and the SQL that they must equal, by name."""

from leafquarry.llm import decontamination, language, licenses, near, packing, quality, substrings, token_counts, token_files, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_packing": packing.op2_packing,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_warc_audit": warc.op5_warc_audit,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_language_id": language.op7_language_id,
    "op8_token_files": token_files.op8_token_files,
    "op9_near_dedup": near.op9_near_dedup,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op5_warc_audit": warc.ORACLE,
    "op10_substring_dedup": substrings.ORACLE,
}
