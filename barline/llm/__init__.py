"""Operators of a training-data pipeline over documents, token files, conversations, pages and vectors."""
