"""tessera: typed memory graphs, retrieval and corpus preparation as Spark DataFrame jobs."""
