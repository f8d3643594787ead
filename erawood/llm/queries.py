"""The queries of the text operators and their SQL, for the driver's entry module."""

from __future__ import annotations

from erawood.llm import bpe, decontamination, langid, licenses, packing, quality, simhash, substring, urls, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_warc_revisits": warc.op2_warc_revisits,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_language_id": langid.op4_language_id,
    "op5_token_counts": bpe.op5_token_counts,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_url_filter": urls.op7_url_filter,
    "op8_retrieval_packing": packing.op8_retrieval_packing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_simhash_dedup": simhash.op10_simhash_dedup,
}
ORACLE_SQL = {
    "op2_warc_revisits": warc.OP2_SQL,
    "op6_substring_dedup": substring.OP6_SQL,
    "op9_quality_rules": quality.OP9_SQL,
}
