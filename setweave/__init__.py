"""Relational set algebra on Spark: relations are DataFrames with set semantics."""
