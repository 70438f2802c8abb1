"""Analytics over collections of documents, as Spark jobs."""
