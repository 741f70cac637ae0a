"""Operators on text corpora, web pages and vectors."""
