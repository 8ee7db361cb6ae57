"""Incremental loading of star-table CSV files with Structured Streaming."""

from mercato.streaming.ingest import start_csv_ingest

__all__ = ["start_csv_ingest"]
