"""Operations of a training-data pipeline over the tables `documents` and `embeddings`."""
