"""A Spark-first engine for searching and maintaining catalogs of file paths."""
