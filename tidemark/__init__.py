"""Tidemark: audit-log provenance analytics, expressed as Spark DataFrame plans."""
