"""Retrieval, grounding and evaluation over filings-shaped tables, as Spark plans."""
