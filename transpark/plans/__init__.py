"""F1-F4 workflows and the catalog of registered driver queries (with DuckDB twins)."""
