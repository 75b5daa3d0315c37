"""Label checks and training-data operations as Spark jobs."""
