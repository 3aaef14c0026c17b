"""Operators on frames: chunking, indexing, retrieval, ranking, context and synchronisation."""
