"""Evidence retrieval, grounding and text-corpus preparation as Spark jobs."""
