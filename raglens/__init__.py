"""raglens: evaluation of retrieval-augmented question answering as table-to-table Spark jobs."""
