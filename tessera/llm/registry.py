"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import language, ledger, media, mixing, packing, pii, resharding, simhash, substring, urls


def queries() -> dict[str, Callable]:
    return {
        "op1_mixing": mixing.query,
        "op2_pii": pii.query,
        "op3_media": media.query,
        "op4_packing": packing.query,
        "op5_urls": urls.query,
        "op6_language_id": language.query,
        "op7_rule_ledger": ledger.query,
        "op8_substring_dedup": substring.query,
        "op9_simhash": simhash.query,
        "op10_resharding": resharding.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op5_urls": urls.SQL, "op7_rule_ledger": ledger.SQL, "op8_substring_dedup": substring.SQL}
