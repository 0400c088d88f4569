"""Readers of documents, pages, transcripts, company lists and configuration."""
