"""Spark jobs for catalog ETL, text indexing, hybrid retrieval and its evaluation."""
