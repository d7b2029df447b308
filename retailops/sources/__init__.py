"""Sources and sinks: the driver's parquet tables, the tidy-table bindings,
report-text lines, and typed table read/write."""

from .bindings import Bindings  # noqa: F401
