"""Training-data operators: packing, exact and approximate vector search, toxicity,
chat formatting, token-id files, near-duplicate documents and lines, source
mixing and PII sanitisation.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered
queries, ``sql.py`` their DuckDB SQL.
"""
