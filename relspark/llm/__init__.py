"""Training-data operators: ten text and vector operators over `documents`, `labels`, `benchmark` and `embeddings`."""
