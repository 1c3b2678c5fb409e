"""Network early-warning analytics as Spark DataFrame operators."""
