"""quillon: retrieval, graph and text analytics as Spark relations."""
