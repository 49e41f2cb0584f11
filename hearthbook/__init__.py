"""Personal-archive analytics as Spark DataFrame operators."""
