"""User-level Spark operators, each DataFrame -> DataFrame."""
