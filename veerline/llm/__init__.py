"""Training-data operators on documents and conversations (nothing else in the library imports this)."""
