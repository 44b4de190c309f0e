"""textloom: corpus building, screening, auditing and scoring as Spark DataFrame plans."""
