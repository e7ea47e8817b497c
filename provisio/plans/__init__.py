"""Composed plans: the end-to-end reserving run, the report, and the query
catalogue used by ``__spark_entry__``."""
