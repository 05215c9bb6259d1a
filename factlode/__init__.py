"""Filings analytics as Spark DataFrame operators."""
