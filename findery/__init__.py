"""findery: a Spark-first retrieval engine (full text, vectors, fusion, versioned indexes)."""
