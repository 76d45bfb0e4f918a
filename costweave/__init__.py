"""Project cost analytics as DataFrame-in, DataFrame-out Spark operators."""
