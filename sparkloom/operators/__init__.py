"""Relational operators over documents, queries, candidates and graphs."""
