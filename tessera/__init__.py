"""tessera: knowledge-graph analytics and retrieval written as ordinary Spark jobs."""
