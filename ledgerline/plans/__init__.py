"""Registered queries: each takes (spark, sf_dir); oracles are the same in DuckDB SQL."""
