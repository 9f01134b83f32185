"""Certificate-compliance analytics expressed as Spark DataFrame programs."""
