"""Corpus retrieval analytics and training-data operators as Spark jobs."""
