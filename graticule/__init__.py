"""Spark-first engine for reconciliation, wiring records, catalogues, stored results and document pipelines."""
