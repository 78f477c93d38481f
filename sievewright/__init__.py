"""Context retrieval, session analytics and dataset building over large document tables, as Spark jobs."""
