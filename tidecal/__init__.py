"""Daily demand analytics as Spark DataFrame operators."""
