"""Training-data operators: ten dealt operators on documents and embeddings. Nothing else in the library imports this."""
