"""Customer-support message analytics as Spark DataFrame operators."""
