"""Operators for large training corpora: scoring, filtering, de-duplication, mixing and tokenising of documents."""
