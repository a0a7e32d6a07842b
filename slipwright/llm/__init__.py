"""Training-data operators: ten corpus jobs over documents and conversations."""
