"""Filing intelligence on Spark: tables, text pipeline, statements, graph and retrieval as DataFrame functions."""
