"""corvella: document ingestion, retrieval and corpus processing as DataFrame operators on Spark."""
