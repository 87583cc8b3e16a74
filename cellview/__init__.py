"""Differentially private views over multi-attribute tables, on Spark."""
