"""Document retrieval and question-answering analytics as Spark jobs."""
