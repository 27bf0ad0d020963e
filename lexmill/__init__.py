"""lexmill: a Spark-first engine for document-heavy professional data."""
