"""Relational operators over the claim graph, chunks, vectors and keyed state."""
