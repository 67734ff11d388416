"""The registered queries and the DuckDB statements they are checked with."""
