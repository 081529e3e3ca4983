"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duskwatch.llm import filter_audit, fingerprints, licenses, mixing, near_dup, packing, prefix_trie, quality_classifier, quality_rules, token_counts, toxicity, url_filters, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_token_counts": token_counts.query,
        "op3_license_scans": licenses.query,
        "op4_quality_rules": quality_rules.query,
        "op5_warc": warc.query,
        "op6_quality_classifier": quality_classifier.query,
        "op7_toxicity": toxicity.query,
        "op8_mixing": mixing.query,
        "op9_fingerprints": fingerprints.query,
        "op10_near_duplicates": near_dup.query,
        "op11_url_filters": url_filters.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scans": licenses.SQL, "op5_warc": warc.SQL, "op8_mixing": mixing.SQL, "op11_url_filters": url_filters.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_filter_audit": filter_audit.SQL}
