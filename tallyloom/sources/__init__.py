"""Reading, writing, previewing and sampling tables."""
from tallyloom.sources.preview import preview_page, sample_records, sample_rows
from tallyloom.sources.tables import read_table, write_table

__all__ = ["preview_page", "read_table", "sample_records", "sample_rows", "write_table"]
