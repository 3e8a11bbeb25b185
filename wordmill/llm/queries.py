"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordmill.llm import decontaminate, editcount, fingerprints, language, licenses, lines, neardup, packing, quotes, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_edit_token_counts": editcount.op2_edit_token_counts,
    "op3_language_id": language.op3_language_id,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_bagminhash_neardup": neardup.op8_bagminhash_neardup,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_chat_quotes": quotes.op10_chat_quotes,
}

ORACLE_SQL: dict[str, str] = {}
