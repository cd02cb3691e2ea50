"""The queries of this subpackage, and corpus_pipeline's where it is present."""

from __future__ import annotations

from . import alignment, decontamination, fill_middle, html_text, line_dedup, packing, quality, sharding, simhash, suffix_dedup, token_counts, vector_dedup, warc

MODULES = (sharding, warc, packing, token_counts, decontamination, quality, vector_dedup, html_text, simhash, suffix_dedup, line_dedup, fill_middle, alignment)


def queries() -> dict:
    from corpus_pipeline import run

    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    return {k: s for m in MODULES for k, s in m.ORACLES.items()} | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
