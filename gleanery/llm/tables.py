"""Written tables of the corpus operators; see ``gleanery.stored``."""

from gleanery.stored import bounded, drop, shared_dir, table, written

__all__ = ["bounded", "drop", "shared_dir", "table", "written"]
