"""Runnable jobs over the library: a batch retrieval run, and training triples from arriving events."""
