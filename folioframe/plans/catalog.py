"""All registered queries of the library, by name, and the SQL that says the same."""

from __future__ import annotations

from . import catalog_changes, catalog_ids, catalog_layout, catalog_locate, catalog_text

#: Columns that DuckDB gives as longs and Spark as integers.
_INTEGERS = {
    "drawings_row_order": ["place"], "specs_row_order": ["place"], "assemble_order": ["place"], "validate_near": ["place"], "merge_id_map": ["n"], "unmatched_issues": ["n_pages"], "char_flags": ["span_idx"],
    "placeholder_ids": ["span_idx", "original_length"], "outline_ranges": ["page_index", "end_page"], "outline_corrections": ["page_index"], "dimension_order": ["sort_order"],
}
_PARTS = (catalog_layout, catalog_ids, catalog_text, catalog_locate, catalog_changes)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
    for name, columns in _INTEGERS.items():
        found[name] = f"SELECT * REPLACE ({', '.join(f'{c}::INTEGER AS {c}' for c in columns)}) FROM ({found[name]})"
    return found
