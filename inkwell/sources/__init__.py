"""Readers and writers of corpora, dictionaries and results."""
