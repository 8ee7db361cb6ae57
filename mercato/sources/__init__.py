"""Sources and sinks: the star adapter over the test tables, CSV files, Parquet."""

from mercato.sources.star import Star, load_star, read_star, star_from_tables, write_star

__all__ = ["Star", "load_star", "read_star", "star_from_tables", "write_star"]
