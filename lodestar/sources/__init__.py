"""Tables, their schemas and snapshots, and the providers of embeddings."""
