"""Operators for preparing training corpora: documents, tokens, embeddings, media and conversations."""
