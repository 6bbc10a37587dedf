"""Evidence and reputation analytics as Spark DataFrame operators."""
