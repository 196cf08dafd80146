"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from cloakwork.llm import chat_format, decontamination, filter_audit, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, substring_dedup, token_counts, toxicity, vector_codes, warc



def pipeline(spark, sf_dir: str):
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op10_near_dedup": near_dedup.op10,
    "op2_secret_scan": secret_scan.op2,
    "op6_decontamination": decontamination.op6,
    "op1_mixing": mixing.op1,
    "op7_token_counts": token_counts.op7,
    "op9_chat_format": chat_format.op9,
    "op8_substring_dedup": substring_dedup.op8,
    "op5_quality_classifier": quality_classifier.op5,
    "op4_toxicity": toxicity.op4,
    "op3_quality_rules": quality_rules.op3,
    "op11_vector_codes": vector_codes.op11,
    "op13_filter_audit": filter_audit.op13,
    "op12_warc": warc.op12,
}

SQL: dict[str, str] = {
    "op10_near_dedup": near_dedup.SQL,
    "op9_chat_format": chat_format.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op13_filter_audit": filter_audit.SQL,
    "op12_warc": warc.SQL,
}
