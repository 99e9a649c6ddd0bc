"""Sources and sinks: parquet tables, raw CSV, the venture fixture, writers."""
