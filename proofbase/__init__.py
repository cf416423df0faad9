"""Evidence engine on Spark: retrieval, verification and run-state operators as DataFrame plans."""
