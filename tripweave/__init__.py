"""Trip analytics as Spark DataFrame transformations."""
