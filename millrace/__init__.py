"""Millrace: corpus, event and data-quality analytics expressed as Spark plans."""
