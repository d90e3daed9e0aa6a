"""Source-corpus analytics as plain Spark DataFrame operators."""
