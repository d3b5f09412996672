"""The queries of this folder, by name, with SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name: module and function.
_WHERE = {
    "op1_benchmark_decontamination": ("decontamination", "op1"),
    "op2_substring_dedup": ("substring_dedup", "op2"),
    "op10_simhash_near_dedup": ("simhash_dedup", "op10"),
    "op3_url_filter": ("url_filter", "op3"),
    "op4_nearest_neighbours": ("vector_search", "op4"),
    "op5_token_output": ("token_file", "op5"),
    "op8_source_mixing": ("mixing", "op8"),
    "op9_secret_scan": ("secret_scan", "op9"),
    "op6_quality_classifier": ("quality", "op6"),
    "op7_suffix_array_dedup": ("suffix_dedup", "op7"),
}
_SQL = {
    "op1_benchmark_decontamination": ("decontamination", "OP1_SQL"),
    "op2_substring_dedup": ("substring_dedup", "OP2_SQL"),
    "op7_suffix_array_dedup": ("suffix_dedup", "OP7_SQL"),
}


def _get(module: str, name: str):
    return getattr(import_module(f"tallyforge.llm.{module}"), name)


QUERIES = {query: _get(*where) for query, where in _WHERE.items()}
SQL = {query: _get(*where) for query, where in _SQL.items()}
