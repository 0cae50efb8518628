"""Structure-aware document retrieval expressed as Spark DataFrame plans."""
