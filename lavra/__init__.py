"""Document retrieval, grounding and evaluation analytics on Spark."""
