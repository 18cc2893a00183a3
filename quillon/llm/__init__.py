"""Operators over training-data tables: documents, embeddings and what is stored from them."""
