"""Sources and sinks: JSON API pages, CSV / parquet tables, test views."""
