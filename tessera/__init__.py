"""Document and retrieval analytics expressed as Spark DataFrame plans."""
